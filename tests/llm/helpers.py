"""Brute-force versions that the operators are held against."""

from __future__ import annotations

import hashlib
import re

WORDS = re.compile("[^\x20\x09-\x0d]+")


def cut_repeats(docs: list[tuple[int, str | None]], window: int = 50) -> list[tuple[int, int, int, str]]:
    """``doc_id, n_words, n_removed, sha256 of what is kept``; every window is compared with all others."""
    split = [(i, WORDS.findall(t or "")) for i, t in docs]
    least: dict[tuple, int] = {}
    for i, words in split:
        for p in range(len(words) - window + 1):
            w = tuple(words[p:p + window])
            if i is not None:
                least[w] = min(least.get(w, i), i)
    out = []
    for i, words in split:
        gone = set()
        for p in range(len(words) - window + 1):
            if i is not None and least[tuple(words[p:p + window])] < i:
                gone.update(range(p, p + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def contaminated(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], n: int = 10) -> list[tuple]:
    """``doc_id, n_words, n_hit, item ids`` by comparing every window of every item with every place of every text."""
    def words(text):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)

    windows = []
    for item, text in items:
        own = words(text)
        if own:
            windows += [(item, tuple(own[i:i + n])) for i in range(max(len(own) - n, 0) + 1)]
    out = []
    for doc, text in docs:
        own, hit, ids = words(text), set(), set()
        for item, window in windows:
            for p in range(len(own) - len(window) + 1):
                if tuple(own[p:p + len(window)]) == window:
                    hit.update(range(p, p + len(window)))
                    ids |= {str(item)} if item is not None else set()
        out.append((doc, len(own), len(hit), ",".join(sorted(ids))))
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Kind, start and end of the base matches that pass, straight from the patterns as they are defined."""
    text, out = text or "", []
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": "[0-9]([\x20-]?[0-9])+", "phone": "\\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip":
                good = all(int(p) <= 255 for p in m[0].split("."))
            elif kind == "card":
                twice = [2 * d - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits))]
                good = 13 <= len(digits) <= 19 and sum(twice) % 10 == 0
            else:
                good = kind == "email" or 9 <= len(digits) <= 15
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def few_edits(a: str, b: str, most: int = 2) -> bool:
    """Whether at most so many insertions, deletions and substitutions turn one text into the other."""
    if abs(len(a) - len(b)) > most:
        return False
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        if min(row) > most:
            return False
        before = row
    return before[-1] <= most


def dedup_lines(docs: list[tuple[int | None, str | None]], near_chars: int = 20) -> list[tuple]:
    """``doc_id, n_lines, n_removed, kept`` by comparing every line with every other; rows must differ."""
    lines = [(i is None, i, r, k, x) for r, (i, t) in enumerate(docs) for k, x in enumerate((t or "").split("\n"))
             if WORDS.search(x)]
    texts = sorted({x for *_, x in lines})
    label = {x: x for x in texts}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    long = [x for x in texts if len(x) >= near_chars]
    for p, x in enumerate(long):
        for y in long[:p]:
            if few_edits(x, y):
                label[find(x)] = find(y)
    first: dict[str, tuple] = {}
    for no_id, i, r, k, x in lines:
        c = find(x)
        first[c] = min(first.get(c, (no_id, i or 0, r, k)), (no_id, i or 0, r, k))
    out = []
    for r, (i, t) in enumerate(docs):
        parts = (t or "").split("\n")
        own = [WORDS.search(x) is not None for x in parts]
        stay = [not w or first[find(x)] == (i is None, i or 0, r, k) for k, (w, x) in enumerate(zip(own, parts))]
        out.append((i, sum(own), len(parts) - sum(stay), "\n".join(x for x, s in zip(parts, stay) if s)))
    return out
