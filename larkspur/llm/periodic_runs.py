"""Runs of periodic words, found with a suffix automaton and link-cut access."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from larkspur.llm.inputs import with_computed

#: Words of a text.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words of the shortest run that is reported.
MIN_WORDS = 12
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class SuffixAutomaton:
    """States of a sequence of small integers: ``longest`` word, suffix ``link``, and the state of every prefix.

    Most states have one way on, kept in ``first`` (its label) and ``target``; further ways are in ``more``.
    """

    def __init__(self, labels: list[int]):
        longest, link = [0], [-1]
        first, target, more = [-1], [0], [None]
        prefixes, last = [], 0

        def to(state: int, label: int) -> int:
            if first[state] == label:
                return target[state]
            others = more[state]
            return -1 if others is None else others.get(label, -1)

        def put(state: int, label: int, value: int) -> None:
            if first[state] in (-1, label):
                first[state], target[state] = label, value
            elif more[state] is None:
                more[state] = {label: value}
            else:
                more[state][label] = value

        def state(length: int) -> int:
            longest.append(length)
            link.append(0)
            first.append(-1)
            target.append(0)
            more.append(None)
            return len(longest) - 1

        for label in labels:
            new = state(longest[last] + 1)
            at = last
            while at >= 0 and to(at, label) < 0:
                put(at, label, new)
                at = link[at]
            if at >= 0:
                follows = to(at, label)
                if longest[follows] == longest[at] + 1:
                    link[new] = follows
                else:
                    clone = state(longest[at] + 1)
                    first[clone], target[clone] = first[follows], target[follows]
                    more[clone] = None if more[follows] is None else dict(more[follows])
                    link[clone] = link[follows]
                    link[follows] = link[new] = clone
                    while at >= 0 and to(at, label) == follows:
                        put(at, label, clone)
                        at = link[at]
            prefixes.append(new)
            last = new
        self.longest, self.link, self.prefixes = longest, link, prefixes


class LinkCutPaths:
    """Preferred paths of a rooted forest, each a splay tree ordered by depth with one colour.

    ``access`` makes the way from a node to the root one path with a new colour. The paths it takes apart were each
    coloured by one earlier access; what it cuts off below keeps its colour.
    """

    def __init__(self, parents: list[int]):
        # Node 0 stands for none, so nodes are shifted by one.
        self.up = [0, *(p + 1 for p in parents)]
        n = len(self.up)
        self.left, self.right, self.colour = [0] * n, [0] * n, [0] * n

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[g] == p:
            left[g] = x
        elif right[g] == p:
            right[g] = x
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        up[b], up[p], up[x] = p, x, g
        up[0] = left[0] = right[0] = 0

    def _splay(self, x: int) -> None:
        """Make ``x`` the top of its path, whose colour it takes over; the colour of other nodes means nothing."""
        up, left, right, colour = self.up, self.left, self.right, self.colour
        while True:
            p = top = up[x]
            if left[p] != x and right[p] != x:
                return
            g = up[p]
            if left[g] == p or right[g] == p:
                top = g
                self._rotate(p if (left[g] == p) == (left[p] == x) else x)
            self._rotate(x)
            colour[x] = colour[top]

    def access(self, node: int, colour: int) -> list[tuple[int, int]]:
        """Colour the way from ``node`` to the root; returns the lowest node and the earlier colour of each path on it."""
        up, right, colours = self.up, self.right, self.colour
        found, below, x = [], 0, node + 1
        while x:
            self._splay(x)
            found.append((x - 1, colours[x]))
            colours[right[x]] = colours[x]
            right[x] = below
            below, x = x, up[x]
        colours[below] = colour
        return found


def repetitions(words: list, min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of ``words``, by start, then period.

    Words are appended in order; the end of a word's prefix colours the suffixes of that prefix, which are the way from
    its state to the root. A path that one earlier end ``j`` had coloured holds the suffixes last seen there, so where
    the longest of them is at least as long as the distance to ``j``, a square of that period ends here. Nothing longer
    ends at ``j``, so it begins where its run begins; to the right the run is followed word by word. A shorter period
    would have put a later end on the path, so the period is the smallest.
    """
    known: dict = {}
    labels = [known.setdefault(w, len(known)) for w in words]
    automaton = SuffixAutomaton(labels)
    paths, longest = LinkCutPaths(automaton.link), automaton.longest
    n, out, reached = len(labels), [], {}
    for end, state in enumerate(automaton.prefixes, 1):
        for node, before in paths.access(state, end):
            period = end - before
            if before and period <= longest[node] and reached.get(period, 0) < end:
                stop = end
                while stop < n and labels[stop] == labels[stop - period]:
                    stop += 1
                reached[period] = stop
                start = end - period - longest[node]
                if stop - start >= min_words:
                    out.append((start, stop - start, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeating_parts(words: list, min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Bounds of parts of ``words`` outside of which no run can lie, so the others need not be appended.

    A run of length ``m`` and period ``p`` holds each of its first ``m - p`` words again one period later, and and
    ``m - p`` is at least half of ``min_words``: every word of it lies in a sequence of half as many words that occurs
    twice in the run. Words that lie in no such sequence part the text, and each part is looked
    at again alone until nothing more falls out. Sequences are compared by hash: equal hashes of different ones only
    keep more.
    """
    g = max(1, (min_words + 1) // 2)
    if len(words) < max(min_words, 2):
        return []
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64) * _ODD
    hashes ^= hashes >> np.uint64(29)
    parts, out = [(0, len(words))], []
    while parts:
        low, high = parts.pop()
        size = high - low - g + 1
        rolled = hashes[low:low + size].copy()
        for k in range(1, g):
            rolled = rolled * _MIX + hashes[low + k:low + k + size]
        ordered = np.sort(rolled)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            continue
        at = np.flatnonzero(np.isin(rolled, twice))
        edges = np.zeros(high - low + 1, np.int64)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + g, -1)
        inside = np.concatenate(([0], np.cumsum(edges[:-1]) > 0, [0])).astype(np.int8)
        step = np.diff(inside)
        for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
            if b - a == high - low:
                out.append((low, high))
            elif b - a >= max(min_words, 2):
                parts.append((low + a, low + b))
    return sorted(out)


def runs_of(words: list, min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """All runs of at least ``min_words`` words, by start, then period."""
    return [(low + start, length, period) for low, high in repeating_parts(words, min_words)
            for start, length, period in repetitions(words[low:high], min_words)]


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words without those that come after the first period of a run, joined by one space."""
    if not runs:
        return " ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    return " ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def find_runs(docs: DataFrame, text_column: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``runs``, an array of start, length and period in words, and the ``collapsed`` text.

    A run is a stretch of consecutive words in which words one period apart are equal, of at least two periods and
    ``min_words`` words, that no neighbouring word extends; its period is the smallest. Runs are ordered by start, then
    period. A null text counts as empty; a text without words has no runs and collapses to nothing. Every row is treated
    alone, so repeated rows, null ids and extra columns pass on; columns called ``runs`` and ``collapsed`` are replaced.
    One pass, no shuffle; a task holds one batch of texts and the automaton of one part of a text, which grows with the
    length of that part.
    """
    run = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])
    arrow = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def factory(names):
        place = names.index(text_column)

        def compute(batch):
            found, texts = [], []
            for text in batch.column(place):
                words = WORD.findall(text.as_py() or "")
                own = runs_of(words, min_words)
                found.append([dict(zip(("start", "length", "period"), r)) for r in own])
                texts.append(collapsed(words, own))
            return [pa.array(found, arrow), pa.array(texts, pa.string())]

        return compute

    return with_computed(docs, [StructField("runs", ArrayType(run)), StructField("collapsed", StringType())], factory)
