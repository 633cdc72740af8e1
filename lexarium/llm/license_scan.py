"""Licence scans over a generalised suffix automaton of licence tokens.

The templates' words build one suffix automaton.  A text's words stream through it, which gives the matching
statistics: at every word the length of the longest template substring that ends there.  A phrase occurs
where that length reaches the phrase's and the automaton's state, or one of its suffix links, is the phrase's.
Long matches, each located in its templates, are chained per template when they follow one another in both
the text and the template; the chain's covered share of the template decides whether the licence is there.  Templates are whole
licences, their paragraphs, and the sentences that name a licence (``licences``).  Paragraphs are stretches of the licences that hold them, and get the parts of
their matches, so a clause is told inside a longer match too.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import licences
from . import textbatch as tb

#: What parts words: every ASCII character but digits and lower-case letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases whose places are counted, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))



@dataclass(frozen=True)
class Template:
    label: str
    family: str  # of the labels that a family's templates give one counts
    words: tuple[str, ...]
    within: tuple[tuple[int, int], ...] = ()  # of a paragraph: the templates that hold it, by number, and its first word there


@dataclass(frozen=True)
class Rules:
    least_match: int = 3  # words of a match that chains
    gap: int = 12  # words of the text that a chain may skip between two matches
    covered: float = 0.8  # share of a template's words from which it is there
    short: int = 15  # templates under this many words must be covered whole: such differ by a word or two
    paragraph: int = 12  # paragraphs of licences of at least this many words are templates of their own


_BREAKS = re.compile(NOT_WORD)


def words_of(text: str) -> tuple[str, ...]:
    """Words of a text, as the scan takes them."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return tuple(w for w in _BREAKS.split(lower) if w)


def templates_of(bodies=licences.BODIES, notes=licences.NOTES, least: int = Rules.paragraph) -> tuple[Template, ...]:
    """Whole licences, their paragraphs, and notes.  A paragraph that several labels of a family share gives the family's name."""
    out = [Template(label, family, words_of(text)) for label, family, text in (*bodies, *notes)]
    owners: dict[tuple[str, tuple[str, ...]], list[tuple[int, int]]] = {}
    for k, (_, family, text) in enumerate(bodies):
        first = 0
        for part in text.split("\n\n"):
            words = words_of(part)
            if least <= len(words) < len(out[k].words):
                owners.setdefault((family, words), []).append((k, first))
            first += len(words)
    for (family, words), within in owners.items():
        labels = {out[k].label for k, _ in within}
        out.append(Template(labels.pop() if len(labels) == 1 else family, family, words, tuple(within)))
    return tuple(out)


@dataclass
class Automaton:
    """Suffix automaton of word ids over several token sequences."""

    following: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    places: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])  # (template, end) of a state's strings
    ends: list[dict[int, list[int]]] = field(default_factory=list)  # the same once closed: by template, in order

    def add(self, template: int, words: list[int]) -> None:
        last = 0
        for end, word in enumerate(words, 1):
            last = self._extend(last, word)
            self.places[last].add((template, end))

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.following.append(following)
        self.link.append(link)
        self.length.append(length)
        self.places.append(set())
        return len(self.length) - 1

    def _clone(self, p: int, word: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.following[q]), self.link[q])
        self.link[q] = copy
        while p != -1 and self.following[p].get(word) == q:
            self.following[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.following[last]:
            q = self.following[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, word, q)
        state, p = self._state(self.length[last] + 1, {}, 0), last
        while p != -1 and word not in self.following[p]:
            self.following[p][word] = state
            p = self.link[p]
        if p != -1:
            q = self.following[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
        return state

    def close(self, least: int, templates: int) -> None:
        """Every state gets the places of the states that link to it, in the first ``templates`` sequences.  States of strings under ``least`` words, which
        common words fill, keep none."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.length[self.link[state]] >= least:
                self.places[self.link[state]] |= self.places[state]
        for size, places in zip(self.length, self.places, strict=True):
            ends: dict[int, list[int]] = {}
            for template, end in sorted(places) if size >= least else ():
                if template < templates:
                    ends.setdefault(template, []).append(end)
            self.ends.append(ends)
        self.places.clear()


#: Pairs of chains and places that are compared one by one; more are compared as a matrix.
FEW = 64


def _grown(chains: list[tuple[int, int, int, int]], end: int, length: int, places: list[int]) -> list[tuple[int, int, int, int]]:
    """The longest chain (text end, template end, covered, text start) that ends with a match at each of its template places: on its own, or after one of ``chains``."""
    if len(chains) * len(places) <= FEW:
        out = []
        for at in places:
            here = (end, at, length, end - length + 1)
            for text_end, template_end, covered, start in chains:
                new = min(length, end - text_end, at - template_end)
                if new > 0 and covered + new > here[2]:
                    here = (end, at, covered + new, start)
            out.append(here)
        return out
    text_end, template_end, covered, start = np.array(chains, np.int64).T
    at = np.array(places, np.int64)
    new = np.minimum(np.minimum(length, end - text_end)[:, None], at[None, :] - template_end[:, None])
    total = np.where(new > 0, covered[:, None] + new, 0)
    which = total.argmax(axis=0)
    most = total[which, np.arange(len(at))]
    after = most > length
    return list(zip([end] * len(at), places, np.where(after, most, length).tolist(), np.where(after, start[which], end - length + 1).tolist(), strict=True))


def _useful(grown: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Without those that cover no more than one of the same text end that ends earlier in the template: whatever follows fits that one as well."""
    out, most = [], 0
    for chain in grown:
        if chain[2] > most:
            most = chain[2]
            out.append(chain)
    return out


@dataclass
class Scanner:
    vocabulary: dict[str, int]
    automaton: Automaton
    phrases: list[tuple[list[int], str]]
    phrase_at: list[list[tuple[int, int]]]  # by state: (words, phrase) of the phrases that are suffixes of its strings
    templates: tuple[Template, ...]
    lengths: list[int]  # of the templates
    parts: list[list[tuple[int, int, int]]]  # by template: its paragraphs in order, as (first word, end, template)
    rules: Rules
    pairs: np.ndarray  # whether a word follows another somewhere in a template or phrase; the last row and column: unknown words

    @staticmethod
    def build(phrases=PHRASES, templates: tuple[Template, ...] | None = None, rules: Rules = Rules()) -> "Scanner":
        """The automaton of all templates and phrases; its size is that of their words, whatever is scanned."""
        vocabulary: dict[str, int] = {}
        templates = templates_of(least=rules.paragraph) if templates is None else templates
        coded = lambda words: [vocabulary.setdefault(w, len(vocabulary)) for w in words]
        automaton = Automaton()
        sequences = [coded(t.words) for t in templates]
        own = [(coded(p.split()), label) for p, label in phrases]
        parts: list[list[tuple[int, int, int]]] = [[] for _ in templates]
        for k, template in enumerate(templates):
            for whole, first in template.within:
                parts[whole].append((first, first + len(template.words), k))
        for k, words in enumerate([*sequences, *(w for w, _ in own)]):
            if k >= len(templates) or not templates[k].within:
                automaton.add(k, words)
        automaton.close(rules.least_match, len(sequences))
        at: list[list[tuple[int, int]]] = [[] for _ in automaton.length]
        for k, (words, _) in enumerate(own):
            state = 0
            for w in words:
                state = automaton.following[state][w]
            at[state].append((len(words), k))
        for state in sorted(range(1, len(automaton.length)), key=automaton.length.__getitem__):
            if automaton.link[state] > 0:
                at[state] += at[automaton.link[state]]
        pairs = np.zeros((len(vocabulary) + 1, len(vocabulary) + 1), bool)
        for words in [*sequences, *(w for w, _ in own)]:
            pairs[words[:-1], words[1:]] = True
        return Scanner(vocabulary, automaton, own, at, templates, [len(s) for s in sequences], [sorted(p) for p in parts], rules, pairs)

    def statistics(self, words: list[int], breaks: list[bool]) -> Iterator[tuple[int, int, int]]:
        """(index, state, length) of the longest match that ends at each word. ``breaks``: no match spans this word and the one before."""
        following, link, longest = self.automaton.following, self.automaton.link, self.automaton.length
        state = length = 0
        for i, (w, new) in enumerate(zip(words, breaks, strict=True)):
            if new:
                state = length = 0
            while state and w not in following[state]:
                state = link[state]
                length = longest[state]
            state = following[state][w]
            length += 1
            yield i, state, length

    def least(self, template: int) -> float:
        return 1.0 if self.lengths[template] < self.rules.short else self.rules.covered

    def scan(self, at: list[int], words: list[int], breaks: list[bool]) -> tuple[list[tuple[int, int]], float, dict[int, list[tuple[int, int, int]]]]:
        """Phrase places as (start, phrase), the largest share of a template that a chain covers, and per template that is there its spans: (words covered,
        first, last), apart from each other.

        ``at``: places in the text of ``words``, all known ones."""
        places: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int]] = []  # end, state, length of matches that don't grow
        before = None
        for i, state, length in self.statistics(words, breaks):
            for size, phrase in self.phrase_at[state]:
                if size <= length:
                    places.append((at[i] - size + 1, phrase))
            if before and length != before[2] + 1 and before[2] >= self.rules.least_match:
                matches.append(before)
            before = (at[i], state, length)
        if before and before[2] >= self.rules.least_match:
            matches.append(before)
        return places, *self._chains(matches)

    def _chains(self, matches: list[tuple[int, int, int]]) -> tuple[float, dict[int, list[tuple[int, int, int]]]]:
        """Matches are joined per template while both their text places and their template places rise."""
        best = 0.0
        found: dict[int, list[tuple[int, int, int]]] = {}
        for template, located in self._located(matches).items():
            starts = np.array([end - length + 1 for end, length, _ in located])
            needed = np.minimum.accumulate(starts[::-1])[::-1].tolist()  # the first word of this match and those that follow
            chains: list[tuple[int, int, int, int]] = []  # text end, template end, covered, text start
            for (end, length, places), needs in zip(located, needed, strict=True):
                near = lambda first: [c for c in chains if first - c[0] <= self.rules.gap + 1]  # noqa: B023, E731
                grown = _useful(_grown(near(end - length + 1), end, length, places))
                chains = near(needs) + grown
                for _, _, covered, start in grown:
                    share = covered / self.lengths[template]
                    best = max(best, share)
                    if share >= self.least(template):
                        spans, span = found.setdefault(template, []), (covered, start, end)
                        if not spans or start > spans[-1][2]:
                            spans.append(span)
                        elif covered > spans[-1][0]:
                            spans[-1] = span
        return min(best, 1.0), found

    def _located(self, matches: list[tuple[int, int, int]]) -> dict[int, list[tuple[int, int, list[int]]]]:
        """By template its matches as (text end, length, template ends), in the text's order.  A match in a licence is one in each of the paragraphs that it meets
        as well, so far as it lies in them."""
        at: dict[int, dict[tuple[int, int], set[int]]] = {}
        for end, state, length in matches:
            for template, places in self.automaton.ends[state].items():
                at.setdefault(template, {}).setdefault((end, length), set()).update(places)
                parts = self.parts[template]
                for place in places if parts else ():
                    k = max(0, bisect_right(parts, (place - length, len(self.templates), 0)) - 1)
                    while k < len(parts) and parts[k][0] < place:
                        first, stop, part = parts[k]
                        inside = min(place, stop) - max(place - length, first)
                        if inside >= self.rules.least_match:
                            at.setdefault(part, {}).setdefault((end - place + min(place, stop), inside), set()).add(min(place, stop) - first)
                        k += 1
        return {template: [(end, length, sorted(places)) for (end, length), places in sorted(found.items())] for template, found in at.items()}

    def labels_of(self, found: dict[int, list[tuple[int, int, int]]]) -> set[str]:
        """Of each family the label of the template with most words covered, of equals that with the larger share, then the first."""
        most: dict[str, tuple] = {}
        for t, spans in found.items():
            covered = max(s[0] for s in spans)
            rank = (covered, covered / self.lengths[t], -t)
            most[self.templates[t].family] = max(most.get(self.templates[t].family, rank), rank)
        return {self.templates[-rank[2]].label for rank in most.values()}


def scan_texts(scanner: Scanner, texts: pa.LargeStringArray) -> list[tuple]:
    """``n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` of each text."""
    w = tb.words(tb.lower_ascii(texts), NOT_WORD)
    n, size = len(texts), len(scanner.vocabulary)
    known = np.array([scanner.vocabulary.get(x, size) for x in w.vocabulary.to_pylist()], np.int64)
    code = known[w.code] if len(w.code) else np.zeros(0, np.int64)
    bounds = w.bounds
    # matches of two words or more lie within runs of word pairs that the automaton has; the rest needn't stream
    joined = np.zeros(len(code) + 1, bool)
    if len(code) > 1:
        joined[1:-1] = scanner.pairs[code[:-1], code[1:]] & (w.row[1:] == w.row[:-1])
    streamed = np.flatnonzero(joined[:-1] | joined[1:])
    ends = np.searchsorted(w.row[streamed], np.arange(n + 1))
    out = []
    for i in range(n):
        total, mine = int(bounds[i + 1] - bounds[i]), streamed[ends[i] : ends[i + 1]]
        if not len(mine):
            out.append((total, 0, None, None, "", "", 0.0, []))
            continue
        places, best, found = scanner.scan((mine - bounds[i]).tolist(), code[mine].tolist(), (~joined[mine]).tolist())
        base = {scanner.phrases[p][1] for _, p in places}
        starts = [s for s, _ in places]
        labels = base | scanner.labels_of(found)
        spans = [{"label": scanner.templates[t].label, "start": s[1], "end": s[2], "covered": min(1.0, s[0] / scanner.lengths[t])} for t in sorted(found) for s in found[t]]
        out.append((total, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else best, spans))
    return out


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """``doc_id`` with what is found in every whole text.

    ``n_base`` counts every place of a phrase, overlapping ones too; ``first_word`` and ``last_word`` are the first and last
    starts.  ``labels`` adds, of each family of licences, that of the template of which chains cover most words, if they cover enough of it.  ``score`` is 1
    with a phrase, else the largest covered share of a template.  ``spans``: of the covered templates, label, first and last word, share.  Null and empty texts have no words and
    nothing else.  Repeated rows and a null ``doc_id`` pass through; other columns are ignored."""
    scanner = scanner or Scanner.build()
    sent = docs.sparkSession.sparkContext.broadcast(scanner)
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(span)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tb.texts_of(batch.column(1))
            for part in tb.slices(texts):
                columns = list(zip(*scan_texts(sent.value, texts[part.start : part.stop]), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,covered:double>>"
    return docs.select("doc_id", "text").mapInArrow(run, ddl)
