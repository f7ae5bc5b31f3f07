"""Text analysis for full-text search: tokens, stop words, stems, term statistics and headlines.

The simple configuration lower-cases and splits; the others also drop stop words and stem. Every distinct word is stemmed once in a worker, not every token. Tokens are
runs of letters and digits.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.arrow import short_batches
from . import stemmers

SPLIT = r"[^\p{L}\p{N}]+"

# --- the published Porter2 (Snowball English) algorithm ---

_V = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

# Words that the published algorithm treats by themselves.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]


def _region(word: str, start: int) -> int:
    """Where the region after the first non-vowel that follows a vowel begins."""
    m = re.compile(f"[{_V}][^{_V}]").search(word, start)
    return m.end() if m else len(word)


def _short(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    return bool(re.search(rf"[^{_V}][{_V}][^{_V}wxY]$", word) or re.fullmatch(rf"[{_V}][^{_V}]", word))


def stem_english(word: str) -> str:
    if len(word) <= 2:
        return word
    word = word.replace("’", "'").lstrip("'")
    if word in _SPECIAL:
        return _SPECIAL[word]
    word = re.sub(rf"(^|[{_V}])y", r"\1Y", word)
    prefix = re.match("gener|commun|arsen", word)
    r1 = prefix.end() if prefix else _region(word, 0)
    r2 = _region(word, r1)
    word = re.sub("('s'|'s|')$", "", word)
    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{_V}]", word[:-2]):
        word = word[:-1]
    if word in _KEPT:
        return word
    # past and progressive
    m = re.search("(eedly|ingly|edly|eed|ing|ed)$", word)
    if m:
        s = m[1]
        if s in ("eed", "eedly"):
            if len(word) - len(s) >= r1:
                word = word[: -len(s)] + "ee"
        elif re.search(f"[{_V}]", word[: -len(s)]):
            word = word[: -len(s)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word.endswith(_DOUBLES):
                word = word[:-1]
            elif r1 >= len(word) and _short(word):
                word += "e"
    # final y
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _V:
        word = word[:-1] + "i"
    # suffixes in the first region
    for s, by in _STEP2:
        if word.endswith(s):
            if len(word) - len(s) >= r1:
                word = word[: -len(s)] + by
            break
    else:
        if word.endswith("ogi") and len(word) - 3 >= r1 and word[-4:-3] == "l":
            word = word[:-1]
        elif word.endswith("li") and len(word) - 2 >= r1 and word[-3:-2] and word[-3] in "cdeghkmnrt":
            word = word[:-2]
    for s, by in _STEP3:
        if word.endswith(s):
            if len(word) - len(s) >= r1:
                word = word[: -len(s)] + by
            break
    else:
        if word.endswith("ative") and len(word) - 5 >= r2:
            word = word[:-5]
    for s in _STEP4:
        if word.endswith(s):
            if len(word) - len(s) >= r2:
                word = word[: -len(s)]
            break
    else:
        if word.endswith("ion") and len(word) - 3 >= r2 and word[-4:-3] in ("s", "t"):
            word = word[:-3]
    if word.endswith("e"):
        if len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _short(word[:-1]):
            word = word[:-1]
    elif word.endswith("l") and len(word) - 1 >= r2 and word[-2:-1] == "l":
        word = word[:-1]
    return word.replace("Y", "y")


# --- the published Snowball German algorithm ---

_GV = "aeiouyäöü"


def stem_german(word: str) -> str:
    word = word.replace("ß", "ss")
    word = re.sub(rf"(?<=[{_GV}])u(?=[{_GV}])", "U", word)
    word = re.sub(rf"(?<=[{_GV}])y(?=[{_GV}])", "Y", word)
    find = re.compile(f"[{_GV}][^{_GV}]").search
    m = find(word)
    r1 = m.end() if m else len(word)
    m = find(word, r1)
    r2 = m.end() if m else len(word)
    r1 = max(r1, 3)
    m = re.search("(ern|em|er|en|es|e|s)$", word)
    if m and m.start() >= r1 and (m[1] != "s" or re.search("[bdfghklmnrt]$", word[: m.start()])):
        word = word[: m.start()]
        if m[1] in ("en", "es", "e") and word.endswith("niss"):
            word = word[:-1]
    m = re.search("(est|en|er|st)$", word)
    if m and m.start() >= r1 and (m[1] != "st" or re.search(".{3}[bdfghklmnt]$", word[: m.start()])):
        word = word[: m.start()]
    m = re.search("(isch|lich|heit|keit|end|ung|ig|ik)$", word)
    if m and m.start() >= r2:
        s, rest = m[1], word[: m.start()]
        if s in ("end", "ung"):
            word = rest
            if word.endswith("ig") and len(word) - 2 >= r2 and not word.endswith("eig"):
                word = word[:-2]
        elif s in ("ig", "ik", "isch"):
            if not rest.endswith("e"):
                word = rest
        elif s in ("lich", "heit"):
            word = rest
            if word.endswith(("er", "en")) and len(word) - 2 >= r1:
                word = word[:-2]
        else:
            word = rest
            if word.endswith("lich") and len(word) - 4 >= r2:
                word = word[:-4]
            elif word.endswith("ig") and len(word) - 2 >= r2:
                word = word[:-2]
    return word.replace("U", "u").replace("Y", "y").translate(str.maketrans("äöü", "aou"))


#: By configuration; one that is missing here only drops stop words.
STEMMERS = {"english": stem_english, "german": stem_german, "spanish": stemmers.spanish, "french": stemmers.french, "swedish": stemmers.swedish, "danish": stemmers.danish, "norwegian": stemmers.norwegian, "portuguese": stemmers.portuguese, "italian": stemmers.italian, "dutch": stemmers.dutch}

_STOP: dict[str, frozenset] = {}


def stop_words(config: str) -> frozenset[str]:
    """The stop words that Spark's own remover ships for a language; the simple configuration has none."""
    if config == "simple":
        return frozenset()
    if config not in _STOP:
        from pyspark.ml.feature import StopWordsRemover

        _STOP[config] = frozenset(w.lower() for w in StopWordsRemover.loadDefaultStopWords(config))
    return _STOP[config]


# --- expressions ---


def tokens(text: Column) -> Column:
    """The tokens of a text in order; null counts as empty."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda t: t != "")


def frequency(text_tokens: Column, term: str) -> Column:
    return F.size(F.filter(text_tokens, lambda t: t == term))


def occurrences(text: Column, term: str) -> Column:
    """How often a text has a term as a token, without making tokens: the term's letters between characters that are none. Null counts as empty."""
    pattern = rf"{term}(?<![\p{{L}}\p{{N}}]{term})(?![\p{{L}}\p{{N}}])"
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern))


def query_terms(query: str, config: str = "simple") -> list[str]:
    """The distinct terms that a plain query asks for: all of them must occur."""
    found = [t for t in re.split(r"[\W_]+", query.lower()) if t]
    stop, stem = stop_words(config), STEMMERS.get(config, lambda w: w)
    return list(dict.fromkeys(stem(t) for t in found if t not in stop))


def matches(text_tokens: Column, terms: list[str]) -> Column:
    """Whether all terms occur; a query without terms matches nothing."""
    if not terms:
        return F.lit(False)
    return F.size(F.array_intersect(text_tokens, F.array(*(F.lit(t) for t in terms)))) == len(terms)


# --- ranking ---


def cover_density(places: list[list[int]], weight: float = 0.1) -> float:
    """Sum over the minimal covers of all terms of weight / (1 + words in a cover that are none of the terms).

    After Clarke, Cormack and Tudhope; for one term it is the weight times the term's frequency. places are ascending, each place is of one term; the time is linear in
    them, times the number of terms.
    """
    if not places or any(not p for p in places):
        return 0.0
    events = sorted((at, k) for k, own in enumerate(places) for at in own)
    latest: dict[int, int] = {}  # by term: the number of its last event
    total, last_start = 0.0, -1
    for n, (at, k) in enumerate(events):
        latest[k] = n
        if len(latest) == len(places):
            start = min(latest.values())
            if start > last_start:  # a cover that holds no other ends here
                total += weight / (1 + (at - events[start][0]) - (n - start))
                last_start = start
    return total


def density(found, terms: list[str]) -> float:
    """Cover density of terms in a list of lexemes."""
    places: dict[str, list[int]] = {t: [] for t in terms}
    for at, token in enumerate(found if found is not None else ()):
        if token in places:
            places[token].append(at)
    return cover_density(list(places.values()))


def rank_texts(terms: list[str]):
    """A pandas UDF from tokens to the cover density of the terms; for one term use 0.1 * frequency, which stays in the JVM."""

    short_batches()

    @F.pandas_udf("double")
    def rank(token_lists: pd.Series) -> pd.Series:
        return pd.Series([density(found, terms) for found in token_lists], dtype=float)

    return rank


class Lexemes(dict):
    """The lexemes of one configuration by word: stems, and the empty string for stop words, which keep their places. Forgets all beyond `most` words."""

    def __init__(self, config: str, stop: frozenset[str], most: int = 100_000):
        super().__init__()
        self.stem, self.stop, self.most = STEMMERS.get(config, lambda w: w), stop, most

    def __missing__(self, word: str) -> str:
        if len(self) >= self.most:
            self.clear()
        out = self[word] = "" if word in self.stop else self.stem(word)
        return out


_LEXEMES: dict[str, Lexemes] = {}


def lexemes_of(config: str, stop: list[str]) -> Lexemes:
    """A worker's own lexemes of a configuration; they stay from batch to batch."""
    if config not in _LEXEMES:
        _LEXEMES[config] = Lexemes(config, frozenset(stop))
    return _LEXEMES[config]


def lexemes(token_column: Column, config: Column):
    """The lexemes of tokens in the configuration of their row, in order; null tokens have none."""
    sent = {c: sorted(stop_words(c)) for c in STEMMERS}

    short_batches()

    @F.pandas_udf("array<string>")
    def analyse(token_lists: pd.Series, configs: pd.Series) -> pd.Series:
        of = {c: lexemes_of(c, sent.get(c, [])) for c in configs.dropna().unique()}
        return pd.Series([None if found is None or c is None else list(map(of[c].__getitem__, found)) for found, c in zip(token_lists, configs, strict=True)], dtype=object)

    return analyse(token_column, config)


#: Letters that stemmers reduce to a plain one.
PLAIN = {"a": "aàáâãäå", "c": "cç", "e": "eèéêë", "i": "iìíîï", "n": "nñ", "o": "oòóôõö", "u": "uùúûü", "s": "sß"}


def stem_pattern(stem: str) -> str:
    """A pattern that every word with this stem begins with: stemmers rewrite its last two letters at most, reduce letters and write ss for one letter."""
    head = stem[: max(1, len(stem) - 2)]
    of = {letter: letters for letters in PLAIN.values() for letter in letters}
    return "".join("[sß]+" if c[0] in "sß" else f"[{of[c]}]" if c in of else re.escape(c) for c in re.findall("[sß]+|.", head))


def may_have_stems(text: Column, stems: list[str]) -> Column:
    """Whether a text has letters that a word with each of the stems begins with; never false where it has such words."""
    low, hit = F.lower(text), F.lit(True)
    for s in stems:
        hit = hit & low.rlike(stem_pattern(s))
    return F.coalesce(hit, F.lit(False))


def language_scores(query: str, configs: list[str]):
    """A pandas UDF from tokens and configuration to the cover density of the query's terms there; null where not all of them occur, or where the query has none."""
    terms = {c: query_terms(query, c) for c in configs}
    sent = {c: sorted(stop_words(c)) for c in configs}

    short_batches()

    @F.pandas_udf("double")
    def rank(token_lists: pd.Series, configs: pd.Series) -> pd.Series:
        of = {c: lexemes_of(c, sent[c]) for c in configs.dropna().unique() if c in sent}  # a worker keeps them, so never without their stop words
        out = []
        for found, c in zip(token_lists, configs, strict=True):
            wanted = terms.get(c) if c is not None else None
            score = density(list(map(of[c].__getitem__, found)), wanted) if wanted and found is not None else 0.0
            out.append(score or None)
        return pd.Series(out, dtype=float)

    return rank


def headline(text: str | None, terms: list[str], stem=lambda w: w, most: int = 35, least: int = 15) -> str | None:
    """One fragment of at most `most` words around the first occurrences of the terms, which are marked; else the leading words."""
    if text is None:
        return None
    words = text.split()
    wanted = set(terms)
    hit = [k for k, w in enumerate(words) if any(stem(t) in wanted for t in re.split(r"[\W_]+", w.lower()) if t)]
    if not hit:
        return " ".join(words[:least])
    start = max(0, min(hit[0] - (most - least) // 2, len(words) - most))
    marked = set(hit)
    return " ".join(f"<b>{w}</b>" if k in marked else w for k, w in enumerate(words[start : start + most], start))


def headlines(terms: list[str], config: str = "simple"):
    short_batches()

    @F.pandas_udf("string")
    def make(texts: pd.Series) -> pd.Series:
        stem = STEMMERS.get(config, lambda w: w)
        return texts.map(lambda t: headline(t, terms, stem))

    return make


def language_headlines(query: str, configs: list[str]):
    """A pandas UDF from text and configuration to a headline in which the words whose stems the query asks for are marked."""
    terms = {c: query_terms(query, c) for c in configs}

    short_batches()

    @F.pandas_udf("string")
    def make(texts: pd.Series, configs: pd.Series) -> pd.Series:
        return pd.Series([headline(t, terms.get(c, []), STEMMERS.get(c, lambda w: w)) for t, c in zip(texts, configs, strict=True)], dtype=object)

    return make
