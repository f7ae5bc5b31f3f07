"""Translation catalogues (PO and POT files) as rows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

def unescape(text: str) -> str:
    """Line breaks, then quotes, then backslashes, one kind after the other, as labels.po_unescaped does for columns."""
    return text.replace("\\n", "\n").replace('\\"', '"').replace("\\\\", "\\")


def parse(text: str) -> list[tuple[str, int, str]]:
    """(msgid, plural index, msgstr) of a catalogue; strings may go on over lines, comments and obsolete entries are skipped."""
    out: list[tuple[str, int, str]] = []
    entry: dict = {}
    into: tuple | None = None

    def finish():
        if "msgid" in entry:
            for k, value in sorted(entry.get("msgstr", {0: ""}).items()):
                out.append((entry["msgid"], k, value))
        entry.clear()

    for line in text.splitlines():
        line = line.strip()
        if line.startswith("#") or not line:
            if not line:
                into = None
            continue
        m = re.match(r'(msgid_plural|msgid|msgctxt|msgstr(?:\[(\d+)\])?)\s+"(.*)"$', line)
        if m:
            key, value = m[1], unescape(m[3])
            if key == "msgid":
                finish()
            if key.startswith("msgstr"):
                into = ("msgstr", int(m[2] or 0))
                entry.setdefault("msgstr", {})[into[1]] = value
            else:
                into = (key,)
                entry[key] = value
        elif into and line.startswith('"') and line.endswith('"') and len(line) > 1:
            value = unescape(line[1:-1])
            if into[0] == "msgstr":
                entry["msgstr"][into[1]] += value
            else:
                entry[into[0]] += value
    finish()
    return out


def read(spark: SparkSession, path: str, pattern: str = "*.po*") -> DataFrame:
    """(path, lang, domain, msgid, plural, msgstr); lang is null for templates."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            rows = []
            for p, content in zip(batch["path"], batch["content"], strict=True):
                m = re.search(r"(?:/([^/]+)/LC_MESSAGES)?/([^/]+)\.pot?$", p)
                rows += [(p, m[1], m[2], *e) for e in parse(bytes(content).decode())] if m else []
            yield pd.DataFrame(rows, columns=["path", "lang", "domain", "msgid", "plural", "msgstr"])

    return files.mapInPandas(run, "path string, lang string, domain string, msgid string, plural int, msgstr string")
