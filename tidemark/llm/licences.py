"""Licence scans with a generalised suffix automaton over licence words.

The automaton accepts every run of words that occurs in a template or in one of the exact phrases.
Texts are streamed through it: at each word it gives, for every template, the longest match that ends there
(matching statistics; runs at places that do not hold the longest one follow from the suffix links). A match
of ``MIN_MATCH`` words or more that does not go on is a link of a chain; a run that stands in a template more than once
is a link at each of its places. A dynamic programme finds for every link the chain up to it that covers most words of
the template, over all earlier links that end no more than ``MAX_GAP`` words before it, in the text and in the
template. A template's span is a chain that covers ``COVERAGE`` of its words; spans of one template do not overlap.
An exact phrase stands at a word if the match there is long enough and its state lies below the phrase's
state in the tree of suffix links.

Only runs of three or more known words are streamed, as no phrase or match is shorter; the rest is
passed over by array operations.

Edge cases: a null text is empty and has no words; no labels give empty strings; score is 1 with an
exact phrase, else the best coverage; of two chains that cover as much the one that ends first counts; repeated rows
get equal results; an empty table gives an empty result; other columns are carried on request, and new columns
replace any of the same name.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .licence_texts import PHRASES, TEMPLATES
from .textkernel import ALNUM_WORDS, Words, chunks

SHORTEST, MIN_MATCH, MAX_GAP, COVERAGE = 3, 4, 6, 0.7


class Automaton:
    """Generalised suffix automaton of sequences of word ids."""

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]  # by state: sequence -> where in it the state's words end
        for k, seq in enumerate(sequences):
            last = 0
            for at, word in enumerate(seq):
                last = self._extend(last, word)
                self.ends[last].setdefault(k, []).append(at + 1)
        for v in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):
            for k, ends in self.ends[v].items():
                if self.link[v]:
                    self.ends[self.link[v]].setdefault(k, []).extend(ends)

    def _state(self, length: int, link: int, out: dict[int, int]) -> int:
        self.next.append(out)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:  # another sequence has been here
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def walk(self, seq: Sequence[int]) -> int:
        v = 0
        for word in seq:
            v = self.next[v][word]
        return v

    def stream(self, words: Sequence[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest match that ends at each word."""
        v = length = 0
        for word in words:
            while v and word not in self.next[v]:
                v = self.link[v]
                length = self.length[v]
            if word in self.next[v]:
                v, length = self.next[v][word], length + 1
            yield v, length


class Scanner:
    """The automaton with its vocabulary, phrases and templates."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        texts = [t for t, _ in (*phrases, *templates)]
        self.labels = [x for _, x in (*phrases, *templates)]
        self.n_phrases = len(phrases)
        words = Words(pa.array(texts), ALNUM_WORDS)
        self.vocabulary = np.unique(words.hash)
        ids = np.searchsorted(self.vocabulary, words.hash)
        seqs = [ids[lo:hi].tolist() for lo, hi in zip(words.first, words.last, strict=True)]
        self.sizes = [len(s) for s in seqs]
        self.auto = Automaton(seqs)
        at = {self.auto.walk(s): k for k, s in enumerate(seqs[: self.n_phrases])}
        self.phrases_at: list[tuple[int, ...]] = [()] * len(self.auto.next)
        #: By state: (template, end in it) of its words, and (template, end, words) where only a shorter ending stands.
        self.holds: list[set[tuple[int, int]]] = [set()] * len(self.auto.next)
        self.shorter: list[list[tuple[int, int, int]]] = [[]] * len(self.auto.next)
        for v in sorted(range(1, len(self.auto.next)), key=lambda v: self.auto.length[v]):
            u = self.auto.link[v]
            self.phrases_at[v] = self.phrases_at[u] + ((at[v],) if v in at else ())
            self.holds[v] = own = {(k, e) for k, ends in self.auto.ends[v].items() if k >= self.n_phrases for e in ends}
            above = [(*x, self.auto.length[u]) for x in self.holds[u] - own] if self.auto.length[u] >= MIN_MATCH else []
            self.shorter[v] = above + self.shorter[u]

    def known_runs(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words (-1: not known) and the runs of known ones within a text, [start, end)."""
        ids = np.searchsorted(self.vocabulary, words.hash)
        ids[ids == len(self.vocabulary)] = 0
        ids = np.where(self.vocabulary[ids] == words.hash, ids, -1) if len(ids) else ids
        known = np.zeros(len(ids) + 2, dtype=bool)
        known[1:-1] = ids >= 0
        cut = np.zeros(len(ids) + 1, dtype=bool)
        cut[words.first] = True
        start = np.flatnonzero(known[1:] & (~known[:-1] | cut))
        end = np.flatnonzero(known[:-1] & (~known[1:] | cut))
        long = end - start >= SHORTEST
        return ids, start[long], end[long]

    def scan(self, ids: Sequence[int], offset: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Of a run: phrase places (start, phrase), and matches that do not go on (template, start, end, end in it)."""
        places, matches = [], []
        before: dict[tuple[int, int], int] = {}
        for i, (v, length) in enumerate(self.auto.stream(ids)):
            for k in self.phrases_at[v]:
                if length >= self.sizes[k]:
                    places.append((offset + i + 1 - self.sizes[k], k))
            now = self._runs(v, length)
            matches += [(k, offset + i - n, offset + i, there) for (k, there), n in before.items() if (k, there + 1) not in now]
            before = now
        matches += [(k, offset + len(ids) - n, offset + len(ids), there) for (k, there), n in before.items()]
        return places, matches

    def _runs(self, v: int, length: int) -> dict[tuple[int, int], int]:
        """Words of the runs that end here, by template and end in it, of ``MIN_MATCH`` words or more."""
        if length < MIN_MATCH:
            return {}
        return {(k, there): n for k, there, n in self.shorter[v]} | dict.fromkeys(self.holds[v], length)

    def chains(self, matches: Sequence[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Spans (template, start, end, words covered) of the best chains, apart from each other in each template."""
        out = []
        by_template: dict[int, list] = {}
        for k, start, end, there in matches:
            by_template.setdefault(k, []).append((start, end, there))
        for k, links in by_template.items():
            links.sort(key=lambda m: (m[1], m[0], m[2]))
            best: list[tuple[int, int]] = []  # words covered, first word
            at = [m[1] for m in links]
            for i, (start, end, there) in enumerate(links):
                found = (end - start, start)
                for j in range(bisect_left(at, start - MAX_GAP), i):  # in order of their ends
                    end0, there0 = links[j][1], links[j][2]
                    fresh = min(end - start, end - end0, there - there0)
                    if fresh > 0 and start - end0 <= MAX_GAP and there - (end - start) - there0 <= MAX_GAP and best[j][0] + fresh > found[0]:
                        found = (best[j][0] + fresh, best[j][1])
                best.append(found)
            starts, ends = [], []  # of the spans taken, in order
            for i in sorted(range(len(links)), key=lambda i: (-best[i][0], links[i][1], best[i][1])):
                covered, start, end = *best[i], links[i][1]
                place = bisect_left(starts, end)
                if place == 0 or ends[place - 1] <= start:
                    starts.insert(place, start)
                    ends.insert(place, end)
                    out.append((k, start, end, covered))
        return out


def scan_batch(scanner: Scanner, column: pa.Array) -> list[tuple]:
    """Per text: number of words, phrase places (start, phrase), and chains (template, start, end, words covered)."""
    words = Words(column, ALNUM_WORDS)
    ids, start, end = scanner.known_runs(words)
    texts = np.searchsorted(words.last, start, side="right")
    places: dict[int, list] = {}
    matches: dict[int, list] = {}
    for text, lo, hi in zip(texts.tolist(), start.tolist(), end.tolist(), strict=True):
        p, m = scanner.scan(ids[lo:hi].tolist(), lo - int(words.first[text]))
        if p:
            places.setdefault(text, []).extend(p)
        if m:
            matches.setdefault(text, []).extend(m)
    return [(n, places.get(text, []), scanner.chains(matches[text]) if text in matches else []) for text, n in enumerate(words.counts().tolist())]


def digest(scanner: Scanner, n: int, places: list, chains: list) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score."""
    cover = [(covered / scanner.sizes[k], scanner.labels[k]) for k, _, _, covered in chains]
    base = {scanner.labels[k] for _, k in places}
    more = base | {label for c, label in cover if c >= COVERAGE}
    score = 1.0 if places else max((c for c, _ in cover), default=0.0)
    starts = [s for s, _ in places]
    return n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(more)), float(min(1.0, score))


def spans_of(scanner: Scanner, places: list, chains: list) -> list[tuple]:
    """(label, words of the template, start, end, coverage) of exact phrases and of the templates' spans, by place."""
    found = [(scanner.labels[k], scanner.sizes[k], s, s + scanner.sizes[k], 1.0) for s, k in places]
    found += [(scanner.labels[k], scanner.sizes[k], s, e, covered / scanner.sizes[k]) for k, s, e, covered in chains if covered >= COVERAGE * scanner.sizes[k]]
    return sorted(found, key=lambda x: (x[2], x[3], x[0], x[1]))


COLUMNS = (("n_words", pa.int64(), T.LongType()), ("n_base", pa.int64(), T.LongType()), ("first_word", pa.int64(), T.LongType()), ("last_word", pa.int64(), T.LongType()), ("base_labels", pa.string(), T.StringType()), ("labels", pa.string(), T.StringType()), ("score", pa.float64(), T.DoubleType()))


def scan(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Per row of ``docs`` (text): the columns ``carry``, then n_words, n_base, first_word, last_word, base_labels, labels, score."""
    made = pickle.dumps(Scanner())  # some hundred KB
    carry = [c for c in carry if c not in [x for x, _, _ in COLUMNS]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = pickle.loads(made)
        for batch in batches:
            for part in chunks(batch, "__text"):
                rows = list(zip(*[digest(scanner, *x) for x in scan_batch(scanner, part.column(part.num_columns - 1))], strict=True))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(v, t) for v, (_, t, _) in zip(rows, COLUMNS, strict=True))], [*carry, *(n for n, _, _ in COLUMNS)])

    schema = T.StructType([*(docs.schema[c] for c in carry), *(T.StructField(n, t) for n, _, t in COLUMNS)])
    return docs.select(*carry, F.col("text").alias("__text")).mapInArrow(run, schema)


SPANS = (("label", pa.string(), T.StringType()), ("template_words", pa.int64(), T.LongType()), ("start_word", pa.int64(), T.LongType()), ("end_word", pa.int64(), T.LongType()), ("coverage", pa.float64(), T.DoubleType()))


def spans(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """A row for each licence span in ``docs`` (text): the columns ``carry``, then label, template_words, start_word, end_word (exclusive), coverage."""
    made = pickle.dumps(Scanner())
    carry = [c for c in carry if c not in [x for x, _, _ in SPANS]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = pickle.loads(made)
        for batch in batches:
            for part in chunks(batch, "__text"):
                found = [(i, *x) for i, (_, places, chained) in enumerate(scan_batch(scanner, part.column(part.num_columns - 1))) for x in spans_of(scanner, places, chained)]
                rows = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in part.columns[:-1]), *(pa.array([f[i] for f in found], t) for i, (_, t, _) in enumerate(SPANS, 1))], [*carry, *(n for n, _, _ in SPANS)])

    schema = T.StructType([*(docs.schema[c] for c in carry), *(T.StructField(n, t) for n, _, t in SPANS)])
    return docs.select(*carry, F.col("text").alias("__text")).mapInArrow(run, schema)
