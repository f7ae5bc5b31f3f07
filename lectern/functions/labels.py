"""Names, labels, paths and other small presentation rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of statuses, names of languages, text-search configurations.
STATUS_COLORS = {"uploading": "badge-info", "extracting": "badge-info", "queued": "badge-info", "processing": "badge-warning", "completed": "badge-success", "error": "badge-error"}
STATUS_TEXTS = {"uploading": "Uploading", "extracting": "Processing", "queued": "Queued", "processing": "Processing", "completed": "Completed", "error": "Error"}
LANGUAGE_NAMES = {"da": "Danish", "de": "German", "en": "English", "es": "Spanish", "fr": "French", "it": "Italian", "nl": "Dutch", "no": "Norwegian", "pl": "Polish", "pt": "Portuguese", "sv": "Swedish"}
PROMPT_LANGUAGES = {"de": "German", "en": "English", "fr": "French", "es": "Spanish", "it": "Italian", "pt": "Portuguese", "nl": "Dutch", "pl": "Polish", "ru": "Russian", "zh": "Chinese", "ja": "Japanese", "ko": "Korean"}
FTS_CONFIGS = {"da": "danish", "de": "german", "en": "english", "es": "spanish", "fr": "french", "it": "italian", "nl": "dutch", "no": "norwegian", "pt": "portuguese", "sv": "swedish"}
SORT_LABELS = {("inserted_at", "desc"): "Newest", ("inserted_at", "asc"): "Oldest", ("title", "asc"): "A-Z", ("title", "desc"): "Z-A"}
UPLOAD_ERRORS = {"too_large": "File is too large (max 100MB)", "too_many_files": "Maximum 10 files can be uploaded at once", "not_accepted": "Only PDF, Word, OpenDocument, and RTF documents are accepted"}
LOCALES = ("en", "de", "fr", "es", "it", "nl", "pl", "pt", "sv", "da", "no")


def lookup(key: Column, table: dict, default: Column) -> Column:
    """The table's value by key: one CASE, which Catalyst folds and pushes."""
    items = list(table.items())
    case = reduce(lambda c, kv: c.when(key == kv[0], kv[1]), items[1:], F.when(key == items[0][0], items[0][1]))
    return case.otherwise(default)


def status_color(status: Column) -> Column:
    return lookup(status, STATUS_COLORS, F.lit("badge-ghost"))


def status_text(status: Column) -> Column:
    return lookup(status, STATUS_TEXTS, F.lit("Unknown"))


def language_name(code: Column) -> Column:
    return lookup(code, LANGUAGE_NAMES, code)


def prompt_language(code: Column) -> Column:
    return lookup(code, PROMPT_LANGUAGES, code)


def fts_config(code: Column) -> Column:
    return lookup(code, FTS_CONFIGS, F.lit("simple"))


def sort_label(field: Column, direction: Column) -> Column:
    return lookup(F.concat_ws(" ", field, direction), {" ".join(k): v for k, v in SORT_LABELS.items()}, F.lit("Sort"))


def upload_error_label(kind: Column) -> Column:
    return lookup(kind, UPLOAD_ERRORS, F.concat(F.lit("Error: "), kind))


def accept_language(header: Column, default: str = "en", supported: tuple[str, ...] = LOCALES) -> Column:
    """The first supported language of an Accept-Language header, without regions and weights."""
    codes = F.transform(F.split(header, ","), lambda part: F.lower(F.element_at(F.split(F.trim(F.element_at(F.split(part, ";"), 1)), "-"), 1)))
    return F.coalesce(F.get(F.filter(codes, lambda c: c.isin(*supported)), F.lit(0)), F.lit(default))


def session_locale(locale: Column, default: str = "en") -> Column:
    return F.when(locale.isin(*LOCALES), locale).otherwise(default)


def title_of(filename: Column) -> Column:
    """A title from an upload's name: without .pdf, separators as spaces."""
    return F.regexp_replace(F.regexp_replace(F.element_at(F.split(filename, "/"), -1), r"\.pdf$", ""), "[_-]+", " ")


def back_url(origin: Column, query: Column, page: Column) -> Column:
    return F.when(origin == "search", F.concat(F.lit("/search?q="), F.url_encode(query), F.when(page.isNotNull() & (page != "1"), F.concat(F.lit("&page="), page)).otherwise(""))).otherwise("/")


def document_dir(doc: Column, root: str = "uploads") -> Column:
    return F.concat_ws("/", F.lit(root), F.lit("documents"), doc)


def pages_dir(doc: Column, root: str = "uploads") -> Column:
    return F.concat_ws("/", document_dir(doc, root), F.lit("pages"))


def pdf_path(doc: Column, root: Column) -> Column:
    return F.concat(F.coalesce(root, F.lit("uploads")), F.lit("/"), doc, F.lit(".pdf"))


def format_route(filename: Column) -> Column:
    ext = F.lower(F.regexp_extract(filename, r"\.[^./]*$", 0))
    return F.when(ext == ".pdf", "pdf").when(ext.isin(".docx", ".doc", ".odt", ".rtf"), "convertible").otherwise("unsupported")


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def po_unescaped(text: Column) -> Column:
    out = text
    for escaped, plain in (("\\n", "\n"), ('\\"', '"'), ("\\\\", "\\")):
        out = F.replace(out, F.lit(escaped), F.lit(plain))
    return out


def page_number_of(raw: Column) -> Column:
    """A page parameter: 1 unless it is a positive whole number."""
    n = F.expr("1").cast("long")
    parsed = F.when(raw.rlike(r"^[+-]?\d{1,18}$"), raw.cast("long"))
    return F.when(parsed > 0, parsed).otherwise(n)


def pagination(total: Column, page: Column, per_page: int = 20) -> Column:
    """Offset, number of pages and the range that is shown."""
    return F.struct(
        ((page - 1) * per_page).alias("offset"),
        F.greatest(F.lit(1).cast("long"), F.ceil(total / per_page)).alias("pages"),
        ((page - 1) * per_page + 1).alias("first"),
        F.least(page * per_page, total).alias("last"),
    )


def clamped_page(page: Column, total: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.least(page, F.coalesce(total, F.lit(1).cast("long"))))


def zoomed(zoom: Column, steps: Column) -> Column:
    return F.greatest(F.lit(50), F.least(F.lit(200), zoom + 25 * steps))


def error_message(template: Column, plural: Column, count: Column, **bindings: Column) -> Column:
    """A validator's message: the plural if there is a count other than one; %{name} and %{count} are filled in, unknown names stay."""
    out = F.when(count.isNotNull() & (count != 1), plural).otherwise(template)
    for name, value in {"count": count, **bindings}.items():
        out = F.when(value.isNull(), out).otherwise(F.replace(out, F.lit(f"%{{{name}}}"), value.cast("string")))
    return out
