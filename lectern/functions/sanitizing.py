"""Sanitizers of names and markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_MARKDOWN = 50_000

# Fixed value: the characters that an underscore takes the place of in a filename.
UNSAFE = r'[<>:"/?*|\x01-\x1f]'


def _steps(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


def filename(name: Column) -> Column:
    """Only word characters, hyphens and single underscores and dots; no dots at the ends."""
    return _steps(name, (r"\.\.", "_"), (r"[^\w\-.]", "_"), (r"\s+", "_"), ("_+", "_"), (r"^\.+|\.+$", ""))


def filename_string(name: Column) -> Column:
    """Every dangerous character becomes an underscore, NUL vanishes; what is no string is empty."""
    return F.coalesce(_steps(name, (r"\.\.", "_"), ("/", "_"), (r"\x00", ""), (UNSAFE, "_")), F.lit(""))


def markdown_string(text: Column) -> Column:
    """Without script elements of one line, script tags, event attributes and images; what is no string is empty."""
    return F.coalesce(_steps(text, (r"(?i)<script[^>]*>.*?</script>", ""), (r"(?i)<script[^>]*>", ""), (r"(?i)</script>", ""), (r"(?i)on\w+\s*=", ""), (r"(?i)<img[^>]*>", "")), F.lit(""))


def markdown(text: Column) -> Column:
    """Without script tags, javascript: and data URLs that a bracket ends, cut to a bounded length."""
    return F.substring(_steps(text, (r"(?i)<script[^>]*>", ""), (r"(?i)</script>", ""), ("(?i)javascript:", ""), (r'(?i)data:[^"\s]*]', "")), 1, MOST_MARKDOWN)


def code_fences(text: Column) -> Column:
    """Without a fence around the whole text."""
    return F.regexp_replace(_steps(text, (r"\A```[^\n]*\n", ""), (r"\n?```\s*\z", "")), r"\A\s+|\s+\z", "")


def snippet_text(text: Column) -> Column:
    """A snippet without highlighting, on one line."""
    return F.trim(_steps(text, ("</?b>", ""), (r"\s+", " ")))
