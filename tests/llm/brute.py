"""Plain reference forms of the operators, one document or pair at a time."""

from __future__ import annotations

import re
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text: str | None, n: int) -> set[tuple[str, ...]]:
    words = WORD.findall(lower(text))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def components(ids: list, links: list[tuple]) -> dict:
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard_components(texts: dict, n: int, least: int, per: int = 100) -> dict:
    sets = {i: shingles(t, n) for i, t in texts.items()}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and per * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    return components(list(sets), links)


def repeats(text: str | None) -> list[int]:
    """For each word, the longest word string that starts there and occurs elsewhere in the text."""
    words = WORD.findall(text or "")
    out = []
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            if i != j:
                k = 0
                while max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                    k += 1
                best = max(best, k)
        out.append(best)
    return out


def covered(lengths: list[int], least: int) -> int:
    return len({i + k for i, n in enumerate(lengths) if n >= least for k in range(n)})
