"""Evaluation passages that stand in training texts, whole or in part.

One Aho-Corasick automaton holds every run of three normalised words of every passage and of its answer after it. It
scans each text once; every match keeps the offsets of its words in the original text. Matches that continue one
another on one diagonal join to runs, and a dynamic programme chains the runs of a passage in order: between two runs
a few words may be changed, added or dropped, and one foreign sentence, of any length, may stand in one place. A text
holds a passage if the words of the best chain reach two fifths of the passage's words, less the one word in ten that
may differ. Words of the answer do not count towards that; where they follow the passage, the answer leaked as well.

Passages are broadcast in slices of bounded size; more passages only mean more scans. A text is scanned whole,
whatever its length, and never leaves its task.

Defined results: null and empty texts, and passages without three words, match nothing; several rows with one
passage_id or doc_id count once each; a null or empty answer never leaks; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread

#: Words of a pattern.
SEED = 3
#: Share of a passage's words that a text must hold, and share of words that may differ.
SHARE, DIFFER = 0.4, 0.1
#: Words that may differ in one place at least; in longer passages it is their share ``DIFFER``.
EDITS = 5
#: Words up to which what stands in between counts as one sentence whatever its marks; beyond, the marks tell.
SENTENCE = 60
#: Bytes of passages in one automaton.
SLICE_BYTES = 8 << 20

_INVISIBLE = dict.fromkeys((0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))


_PLAIN = re.compile(r"[A-Za-z]+|[0-9]+")
_END = re.compile(r"[.!?\u2026\u3002]|\n\s*\n")

#: Scanners of this process, by the digest of their passages.
_ready: dict[str, Scanner] = {}


def words(text: str) -> tuple[list[str], list[re.Match]]:
    """Normalised words of a text, with their matches in it."""
    if text.isascii():
        found = list(_PLAIN.finditer(text))
        return [m.group().lower() for m in found], found
    import regex

    found = list(regex.finditer(r"\p{L}(?:[\p{L}\p{M}\u00AD\u200B-\u200D\u2060\uFEFF])*|\p{N}+", text))
    return [w.lower() if w.isascii() else unicodedata.normalize("NFKC", w).translate(_INVISIBLE).casefold() for w in (m.group() for m in found)], found


class Sentences:
    """Where the sentences of a text end, counted in words."""

    def __init__(self, text: str, matches: list[re.Match]):
        self.ends = [k + 1 for k in range(len(matches) - 1) if _END.search(text, matches[k].end(), matches[k + 1].start())]
        self.longest = max((b - a for a, b in zip([0, *self.ends], [*self.ends, len(matches)])), default=0)

    def one(self, start: int, end: int) -> bool:
        """Whether the words from ``start`` to ``end`` are at most one sentence, the rest of one before it aside."""
        return end - start <= SENTENCE or bisect_right(self.ends, end) - bisect_left(self.ends, start) <= 2


class Scanner:
    """Finds passages (id, text, answer) in texts."""

    def __init__(self, passages: list[tuple[int, str, str | None]], share: float = SHARE, differ: float = DIFFER):
        import ahocorasick

        self.sizes: dict[int, int] = {}
        self.need: dict[int, float] = {}
        self.edits: dict[int, int] = {}
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for number, text, answer in passages:
            own = words(text)[0]
            if len(own) < SEED:
                continue
            self.sizes[number], self.need[number] = len(own), share * (1 - differ) * len(own)
            self.edits[number] = max(EDITS, ceil(differ * len(own)))
            own += words(answer or "")[0]
            for k in range(len(own) - SEED + 1):
                places[" " + " ".join(own[k : k + SEED]) + " "].append((number, k))
        self.automaton = ahocorasick.Automaton()
        for pattern, at in places.items():
            self.automaton.add_word(pattern, (tuple(p for p, _ in at), at))
        if places:
            self.automaton.make_automaton()

    def _runs(self, plain: list[str]) -> tuple[dict[int, list[list[int]]], set[tuple[int, int]]]:
        """Runs [first word in the text, first word in the passage, words] of each passage; (passage, word) where answers begin."""
        joined = " " + " ".join(plain) + " "
        # a run of n words has n - SEED + 1 matches, so that a passage needs a third of its words as matches at least
        hits = list(self.automaton.iter(joined))
        seen = Counter(chain.from_iterable(places[0] for _, places in hits))
        wanted = {p for p, n in seen.items() if n * SEED >= self.need[p]}
        runs: dict[int, list[list[int]]] = defaultdict(list)
        answers: set[tuple[int, int]] = set()
        if not wanted:
            return runs, answers
        number_at, at = {}, 0
        for k, w in enumerate(plain):
            at += len(w) + 1
            number_at[at] = k  # the blank after word k
        open_runs: dict[tuple[int, int], list[int]] = {}
        for end, (passages, places) in hits:
            if wanted.isdisjoint(passages):
                continue
            first = number_at[end] - SEED + 1
            for passage, k in places:
                if passage not in wanted:
                    continue
                if k + SEED > self.sizes[passage]:
                    answers.add((passage, first + self.sizes[passage] - k))
                    continue
                run = open_runs.get((passage, first - k))
                if run and run[0] + run[2] - SEED + 1 == first:
                    run[2] += 1
                else:
                    run = open_runs[passage, first - k] = [first, k, SEED]
                    runs[passage].append(run)
        return runs, answers

    def _dense(self, passage: int, runs: list[list[int]], between: Sentences) -> Iterator[list[list[int]]]:
        """Stretches of runs that hold enough words close together to be worth chaining."""
        reach, need = 1.3 * self.sizes[passage] + max(SENTENCE, between.longest), self.need[passage]
        total = low = 0
        stretch: list[int] | None = None
        for high, run in enumerate(runs):
            total += run[2]
            while runs[low][0] < run[0] - reach:
                total -= runs[low][2]
                low += 1
            if total >= need:
                if stretch and low <= stretch[1] + 1:
                    stretch[1] = high
                else:
                    if stretch:
                        yield runs[stretch[0] : stretch[1] + 1]
                    stretch = [low, high]
        if stretch:
            yield runs[stretch[0] : stretch[1] + 1]

    def _chain(self, passage: int, runs: list[list[int]], between: Sentences) -> tuple[int, int, int]:
        """(words, first word, end word) of the best chain of runs, in order in text and passage."""
        edits = self.edits[passage]
        reach, best, top = 1.3 * self.sizes[passage] + max(SENTENCE, between.longest), [], (0, 0, 0)
        for j, (d, p, n) in enumerate(runs):
            state = [(n, d), None]  # without and with a foreign sentence: words, first word
            for q in range(j - 1, -1, -1):
                dq, pq, nq = runs[q]
                if d - dq > reach:
                    break
                gap_d, gap_p = d - dq - nq, p - pq - nq
                over = max(0, -gap_d, -gap_p)
                if p <= pq or over >= n or gap_p > edits or gap_d > edits and not between.one(dq + nq, d):
                    continue
                for used in (0, 1):
                    if best[q][used] is None:
                        continue
                    then = used if gap_d <= edits else used + 1
                    if then < 2:
                        total = best[q][used][0] + n - over
                        if state[then] is None or total > state[then][0]:
                            state[then] = (total, best[q][used][1])
            best.append(state)
            for s in state:
                if s and s[0] > top[0]:
                    top = (s[0], s[1], d + n)
        return top

    def scan(self, text: str | None) -> list[tuple[int, int, int, int, bool]]:
        """(passage, matched words, start, end, answer) for each passage the text holds; offsets in the original text."""
        if not text or not self.sizes:
            return []
        plain, matches = words(text)
        found = []
        runs_of, answers = self._runs(plain)
        between = Sentences(text, matches) if runs_of else None
        for passage, runs in runs_of.items():
            if sum(r[2] for r in runs) < self.need[passage]:
                continue
            runs.sort()
            chains = [self._chain(passage, part, between) for part in self._dense(passage, runs, between)]
            if chains and (best := max(chains))[0] >= self.need[passage]:
                answered = any(p == passage and best[1] < at <= best[2] + self.edits[passage] for p, at in answers)
                found.append((passage, best[0], matches[best[1]].start(), matches[best[2] - 1].end(), answered))
        return found


def _scanner(passages: list[tuple[int, str, str | None]], share: float, differ: float) -> Scanner:
    """The scanner of these passages, made once in each process."""
    key = hashlib.sha256(repr((passages, share, differ)).encode()).hexdigest()
    if key not in _ready:
        _ready.clear()
        _ready[key] = Scanner(passages, share, differ)
    return _ready[key]


def leaks(documents: DataFrame, passages: DataFrame, share: float = SHARE, differ: float = DIFFER) -> DataFrame:
    """(doc_id, passage_id, matched_words, start, end, answer): the passages that each document holds, where, and whether the answer follows."""
    spark = documents.sparkSession
    rows = spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text"))
    found = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("passage_id", "matched_words", "start", "end")] + [T.StructField("answer", T.BooleanType())]))

    def pass_over(part: list[tuple[int, str, str | None]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(part)

        @F.pandas_udf(found)
        def scan(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            scanner = _scanner(sent.value, share, differ)
            for batch in texts:
                yield batch.map(scanner.scan)

        return rows.select("doc_id", F.explode(scan("text")).alias("x")).select("doc_id", "x.*")

    # the passages come to the driver one slice at a time
    answer = F.col("answer").cast("string") if "answer" in passages.columns else F.lit(None).cast("string")
    kept = passages.where("passage_id is not null and text is not null").select("passage_id", "text", answer.alias("answer")).groupBy("passage_id").agg(F.min(F.struct("text", "answer")).alias("x")).select("passage_id", "x.*")
    out, part, size = None, [], 0
    for row in kept.toLocalIterator():
        part.append((row.passage_id, row.text, row.answer))
        size += len(row.text) + len(row.answer or "")
        if size > SLICE_BYTES:
            more = pass_over(part)
            out, part, size = (out.unionByName(more) if out else more), [], 0
    if part or out is None:
        more = pass_over(part)
        out = out.unionByName(more) if out else more
    return out.dropDuplicates(["doc_id", "passage_id"])
