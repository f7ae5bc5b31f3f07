"""Slow versions of operators for comparison: plain Python over whole texts, written from the definitions and not from the modules under test."""

import math
import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")
SPACES = " \t\n\r\x0b\x0c"
MASK = (1 << 32) - 1


def base_measures(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    return len(words), len({i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)})


def base_failed(text):
    n, repeat = base_measures(text)
    return n < 50 or 100 * repeat > 50 * n


def class_of(c):
    if ord(c) > 127:
        return 6
    for k, members in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", SPACES, "#*$%&|<>")):
        if c in members:
            return k
    return 5


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shares(text, common):
    """The shares of character classes (by bytes) and of common words, the empty string standing for all other words."""
    classes, words = Counter(), Counter()
    for c in text:
        classes[class_of(c)] += len(c.encode())
    every = {w for of in common.values() for w in of}
    for w in WORD.findall(lower(text)):
        words[w if w in every else ""] += 1
    return classes, words


def distance(p, q):
    a, b = sum(p.values()), sum(q.values())
    if not a or not b:
        return 0.0
    out = 0.0
    for k in set(p) | set(q):
        x, y = p.get(k, 0) / a, q.get(k, 0) / b
        m = (x + y) / 2
        out += sum(0.5 * z * math.log2(z / m) for z in (x, y) if z)
    return math.sqrt(max(0.0, out))


def references(texts, common, units):
    refs = {}
    for text in texts:
        if base_failed(text):
            continue
        classes, words = shares(text, common)
        hits = {lang: sum(words[w] for w in set(of)) for lang, of in common.items()}
        lang = max(hits, key=lambda x: hits[x])
        if not hits[lang]:
            continue
        both = refs.setdefault(lang, (Counter(), Counter()))
        for sums, own in zip(both, (classes, words), strict=True):
            total = sum(own.values())
            for k, n in own.items():
                sums[k] += round(n / total * units)
    return refs


def kept(text, refs, common, class_limit, word_limit):
    if base_failed(text):
        return False
    if not refs:
        return True
    n = base_measures(text)[0]
    classes, words = shares(text, common)
    weights = {lang: sum(words[w] for w in set(common[lang])) + 1e-9 for lang in refs}
    blend = (Counter(), Counter())
    for lang, both in refs.items():
        for sums, own in zip(blend, both, strict=True):
            for k, x in own.items():
                sums[k] += weights[lang] / sum(weights.values()) * x / sum(own.values())
    limits = [a + b / math.sqrt(n) for a, b in (class_limit, word_limit)]
    worst = min(max(distance(classes, a) / limits[0], distance(words, b) / limits[1]) for a, b in [*refs.values(), blend])
    return worst <= 1


def subword_features(raw, log2):
    """Buckets of the hashed character n-grams, words, word pairs and repetitions of a text."""
    b = [32 if c in SPACES.encode() else c for c in b" " + raw + b" "]
    out = []
    for n in (2, 3, 4):
        for i in range(len(b) - n + 1):
            h = b[i]
            for c in b[i + 1 : i + n]:
                h = h * 0x01000193 + c & MASK
            out.append(h + n * 0x85EBCA6B & MASK)
    words = []
    for word in bytes(b).split():
        words.append(sum((c + 1) * pow(0x01000193, k % 64 + 1, 1 << 32) for k, c in enumerate(word)) & MASK)
    out += [w * 0xC2B2AE35 & MASK for w in words]
    for a, c in zip(words, words[1:], strict=False):
        out.append(a * 0x27D4EB2F + c & MASK)
        if a == c:
            out.append(0x51ED270B)
    return [(h * 0x9E3779B1 & MASK) >> 32 - log2 for h in out]


def train(examples, vectors, layer, orders, step, log2):
    """Stochastic gradient descent on plain lists, from given first values and orders of the examples; returns the folded table and the bias."""
    share = (sum(y for _, y in examples) + 1) / (len(examples) + 2)
    bias = math.log(share / (1 - share))
    dim, total, done = len(layer[0]), len(orders) * len(examples), 0
    found = [Counter(subword_features(raw, log2)) for raw, _ in examples]
    for order in orders:
        for k in order:
            n = sum(found[k].values())
            hidden = [sum(c / n * vectors[f][d] for f, c in found[k].items()) for d in range(dim)]
            logits = [sum(x * y for x, y in zip(row, hidden, strict=True)) for row in layer]
            logits[1] += bias
            top = max(logits)
            p = [math.exp(x - top) for x in logits]
            p = [x / sum(p) - (c == examples[k][1]) for c, x in enumerate(p)]
            rate = step * (1 - done / total)
            back = [sum(layer[c][d] * p[c] for c in (0, 1)) for d in range(dim)]
            for c in (0, 1):
                for d in range(dim):
                    layer[c][d] -= rate * 0.1 * p[c] * hidden[d]
            for f, c in found[k].items():
                for d in range(dim):
                    vectors[f][d] -= rate * c / n * min(400, len(found[k])) * back[d]
            done += 1
    return [sum((layer[1][d] - layer[0][d]) * v[d] for d in range(dim)) for v in vectors], bias


def score(raw, table, bias):
    found = subword_features(raw, len(table).bit_length() - 1)
    return 1 / (1 + math.exp(-(bias + sum(float(table[f]) for f in found) / max(1, len(found)))))
