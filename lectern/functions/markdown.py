"""Markdown as safe HTML, time-ordered ids and interpolated messages, in plain Python with Column forms where rows need them."""

from __future__ import annotations

import hashlib
import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.arrow import short_batches

# Elements and attributes that sanitized HTML may hold.
ALLOWED = frozenset("a abbr b blockquote br code del em h1 h2 h3 h4 h5 h6 hr i img ins li ol p pre s span strong sub sup table tbody td th thead tr u ul".split())
ATTRIBUTES = {"a": {"href", "title"}, "img": {"src", "alt", "title"}}
SAFE_URL = re.compile(r"(?:https?:|mailto:|/|#|[^:]*$)", re.I)


def inline(text: str) -> str:
    kept: list[str] = []

    def keep(code: str) -> str:
        kept.append(code)
        return f"\0{len(kept) - 1}\0"

    text = re.sub(r"(`+)(.+?)\1", lambda m: keep(f"<code>{html.escape(m[2].strip(), False)}</code>"), text.replace("\0", ""))
    text = html.escape(text, False).replace("&lt;br&gt;", "<br>")
    text = re.sub(r"!\[([^\]]*)\]\(([^)\s]+)\)", lambda m: f'<img src="{m[2]}" alt="{m[1]}">' if SAFE_URL.match(m[2]) else m[1], text)
    text = re.sub(r"\[([^\]]+)\]\(([^)\s]+)\)", lambda m: f'<a href="{m[2]}">{m[1]}</a>' if SAFE_URL.match(m[2]) else m[1], text)
    text = re.sub(r"\*\*(.+?)\*\*|__(.+?)__", lambda m: f"<strong>{m[1] or m[2]}</strong>", text)
    text = re.sub(r"\*(.+?)\*|(?<!\w)_(.+?)_(?!\w)", lambda m: f"<em>{m[1] or m[2]}</em>", text)
    return re.sub("\0(\\d+)\0", lambda m: kept[int(m[1])], text)


#: Quotes in quotes beyond this depth are text.
DEEPEST = 100


def nested(items: list[tuple[int, str, str]]) -> str:
    """Items (indentation, ul or ol, text) as lists in lists: what is indented further is a list inside the item before."""
    out, open_lists = [], []
    for indent, tag, text in items:
        while open_lists and indent < open_lists[-1][0]:
            out.append(f"</li></{open_lists.pop()[1]}>")
        if open_lists and indent < open_lists[-1][0] + 2 and tag == open_lists[-1][1]:
            out.append("</li>")
        else:
            if open_lists and indent < open_lists[-1][0] + 2:
                out.append(f"</li></{open_lists.pop()[1]}>")
            out.append(f"<{tag}>")
            open_lists.append((indent, tag))
        out.append(f"<li>{inline(text)}")
    return "".join(out) + "".join(f"</li></{tag}>" for _, tag in reversed(open_lists))


def to_html(text: str | None) -> str:
    """Headings, paragraphs, lists, quotes, rules, tables and code; raw HTML is shown, not run. Null and empty texts are empty. Quotes are worked off from a stack."""
    out: list[str] = []
    frames = [((text or "").replace("\r\n", "\n").split("\n") if text else [], 0, "")]
    while frames:
        lines, k, close = frames.pop()
        paragraph, items, quote = [], [], []

        def flush():
            if paragraph:
                out.append(f"<p>{inline(chr(10).join(paragraph))}</p>")
                paragraph.clear()
            if items:
                out.append(nested(items))
                items.clear()

        while k < len(lines):
            line = lines[k]
            is_quote = line.startswith(">") and len(frames) < DEEPEST
            if quote and not is_quote:
                break
            fence = re.match(r"\s*(```+|~~~+)", line)
            bullet = re.match(r"(\s*)(?:([-*+])|(\d+)[.)])\s+(.*)", line)
            if is_quote:
                flush()
                quote.append(line[1:].removeprefix(" "))
            elif fence:
                flush()
                end = next((j for j in range(k + 1, len(lines)) if lines[j].strip().startswith(fence[1])), len(lines))
                out.append("<pre><code>" + html.escape("\n".join(lines[k + 1 : end]), False) + "</code></pre>")
                k = end
            elif not line.strip():
                flush()
            elif m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", line):
                flush()
                out.append(f"<h{len(m[1])}>{inline(m[2])}</h{len(m[1])}>")
            elif re.fullmatch(r"\s*([-*_])(?:\s*\1){2,}\s*", line):
                flush()
                out.append("<hr>")
            elif bullet:
                if paragraph:
                    flush()
                items.append((len(bullet[1].expandtabs(4)), "ul" if bullet[2] else "ol", bullet[4]))
            elif "|" in line and k + 1 < len(lines) and re.fullmatch(r"\s*\|?[\s:|-]*-[\s:|-]*\|?\s*", lines[k + 1]) and "|" in lines[k + 1]:
                flush()
                row = lambda s, tag: "<tr>" + "".join(f"<{tag}>{inline(c.strip())}</{tag}>" for c in s.strip().strip("|").split("|")) + "</tr>"
                body, j = [], k + 2
                while j < len(lines) and "|" in lines[j]:
                    body.append(row(lines[j], "td"))
                    j += 1
                out.append(f"<table><thead>{row(line, 'th')}</thead><tbody>{''.join(body)}</tbody></table>")
                k = j - 1
            elif items and line.startswith("  "):
                items[-1] = (*items[-1][:2], items[-1][2] + " " + line.strip())
            else:
                if items:
                    flush()
                paragraph.append(line.strip())
            k += 1
        flush()
        if quote:
            out.append("<blockquote>")
            frames.append((lines, k, close))
            frames.append((quote, 0, "</blockquote>"))
        else:
            out.append(close)
    return "".join(out)


def sanitized(markup: str) -> str:
    """HTML with allowed elements and attributes alone; scripts and styles go with what they hold."""
    markup = re.sub(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", "", markup)

    def element(m: re.Match) -> str:
        tag = m[2].lower()
        if tag not in ALLOWED:
            return ""
        kept = ""
        for name, a, b, c in re.findall(r"""([\w-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", m[3] or ""):
            value = a or b or c
            if name.lower() in ATTRIBUTES.get(tag, ()) and (name.lower() not in ("href", "src") or SAFE_URL.match(html.unescape(value).strip())):
                kept += f' {name.lower()}="{html.escape(html.unescape(value))}"'
        return f"<{m[1]}{tag}{kept if not m[1] else ''}>"

    return re.sub(r"<(/?)([a-zA-Z][\w-]*)([^<>]*)>", element, markup)


def rendered(text: Column | str) -> Column:
    """A Column of Markdown as safe HTML; a text that cannot be read as Markdown is shown as it is."""

    def safe(t: str | None) -> str:
        try:
            return sanitized(to_html(t))
        except Exception:  # noqa: BLE001  one text must not fail the others
            return f"<p>{html.escape(t or '', False)}</p>"

    short_batches()

    @F.pandas_udf("string")
    def render(texts: pd.Series) -> pd.Series:
        return texts.map(safe, na_action=None)

    return render(text)


def uuid7(ms: int, salt: str) -> str:
    """A version 7 id of a time and a salt: ids of later milliseconds sort after earlier ones, and a retried task makes the same id."""
    h = int.from_bytes(hashlib.sha256(f"{ms}/{salt}".encode()).digest()[:10], "big")
    n = (ms & (1 << 48) - 1) << 80 | 7 << 76 | (h >> 62 & 0xFFF) << 64 | 2 << 62 | h & (1 << 62) - 1
    s = f"{n:032x}"
    return f"{s[:8]}-{s[8:12]}-{s[12:16]}-{s[16:20]}-{s[20:]}"


def uuid7_column(ts, salt):
    """The same as a Column of (timestamp, salt), inside the JVM."""
    stamp = F.lpad(F.lower(F.hex(F.unix_millis(ts))), 12, "0")
    h = F.sha2(F.concat(F.unix_millis(ts).cast("string"), F.lit("/"), salt.cast("string")), 256)
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.element_at(F.split(variant, ""), (F.pmod(F.conv(F.substring(h, 4, 1), 16, 10).cast("int"), F.lit(4)) + 1))
    return F.concat_ws("-", F.substring(stamp, 1, 8), F.substring(stamp, 9, 4), F.concat(F.lit("7"), F.substring(h, 1, 3)), F.concat(nibble, F.substring(h, 5, 3)), F.substring(h, 8, 12))


def message(template: str, bindings: dict, plural: str | None = None) -> str:
    """A message with %{name} filled in; with a count other than one the plural template is used."""
    chosen = plural if plural is not None and bindings.get("count", 1) != 1 else template
    return re.sub(r"%\{(\w+)\}", lambda m: str(bindings[m[1]]) if m[1] in bindings else m[0], chosen)
