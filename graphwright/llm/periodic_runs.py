"""Runs of words that repeat with a period, found by a suffix automaton with link-cut access.

Words are appended one by one. The automaton's suffix-link tree is kept as preferred paths, each a
splay tree and each of one colour: the place where its strings ended last. Access to the new
prefix's state walks up the paths; where it enters one, all strings up to the state entered, the
longest that ended there, end again here. If the distance of the two ends is no more than that
length, a square ends here, and it reaches as far left as its period holds. Then the whole way
gets the new colour. Squares with one start and period are a run that grows to the right, so runs
are exact: maximal, with their smallest period (a smaller one would have ended later). An append
changes O(log n) paths on average.

Only words that can be in a run are appended. A run of a length of at least `least` words and
`times` periods has each of its windows of `window` words twice, so what lies outside stretches of
windows that come twice in their text is passed over; a stretch holds each run that it meets whole.

Texts are worked on one by one and whole, in the tasks that read them; there is no shuffle. A task
holds the automaton of one stretch, some 500 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphwright.llm.words import Words, slices, text_bytes, unused

#: A run has at least so many words and so many periods.
LEAST, TIMES = 24, 3

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)


class SuffixPaths:
    """A suffix automaton whose suffix-link tree is a forest of coloured preferred paths.

    State 1 is the empty string, 0 is none. left, right and up are the splay trees, shorter strings
    to the left; the up of a splay tree's root leads to the state above its path. colour counts at
    splay roots only.
    """

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}, {}]
        self.length, self.link = [0, 0], [0, 0]
        self.left, self.right, self.up, self.colour = [0, 0], [0, 0], [0, 0], [-1, -1]
        self.last = 1
        self.size = 0
        #: last word of the squares of one (start, period)
        self.squares: dict[tuple[int, int], int] = {}

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.length.append(length)
        self.link.append(link)
        for of in (self.left, self.right, self.up):
            of.append(0)
        self.colour.append(-1)
        return len(self.next) - 1

    def _splay(self, x: int) -> None:
        """Makes x the root of its splay tree; the tree's colour moves with it."""
        left, right, up = self.left, self.right, self.up
        root = x
        while (p := up[x]) and (left[p] == x or right[p] == x):
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                root = g
                turns = (p, x) if (left[g] == p) == (left[p] == x) else (x, x)
            else:
                root = p
                turns = (x,)
            for v in turns:
                y = up[v]
                z = up[y]
                if left[y] == v:
                    inner = left[y] = right[v]
                    right[v] = y
                else:
                    inner = right[y] = left[v]
                    left[v] = y
                if inner:
                    up[inner] = y
                if z:
                    if left[z] == y:
                        left[z] = v
                    elif right[z] == y:
                        right[z] = v
                up[y], up[v] = v, z
        self.colour[x] = self.colour[root]

    def append(self, word: int) -> None:
        """One more word: the automaton grows, and the way of the new prefix is accessed."""
        after, length, link = self.next, self.length, self.link
        at = self.size
        self.size += 1
        new = self._state(at + 1, 0, {})
        p = self.last
        while p and word not in after[p]:
            after[p][word] = new
            p = link[p]
        above = 1
        if p:
            q = above = after[p][word]
            if length[q] != length[p] + 1:
                above = self._state(length[p] + 1, link[q], dict(after[q]))
                while p and after[p].get(word) == q:
                    after[p][word] = above
                    p = link[p]
                link[q] = above
                # the copy goes right above q on its path
                self._splay(q)
                top = self.left[q]
                self.left[above], self.left[q], self.up[above] = top, above, q
                if top:
                    self.up[top] = above
        link[new] = self.up[new] = above
        self.last = new
        self._access(new, at)

    def _access(self, x: int, at: int) -> None:
        """Joins the paths from x to the root into one of a new colour; notes the squares that end here."""
        right, up, colour, length = self.right, self.up, self.colour, self.length
        while w := up[x]:
            self._splay(w)
            period = at - colour[w]
            if 0 < period <= length[w] and colour[w] >= 0:
                self.squares[at + 1 - length[w] - period, period] = at
            if right[w]:
                colour[right[w]] = colour[w]
            right[w] = x
            x = w
        colour[x] = at


def runs_of(words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list, by start and period; its parts may be any values with a hash."""
    paths, numbers = SuffixPaths(), {}
    for word in words:
        paths.append(numbers.setdefault(word, len(numbers)))
    found = ((start, last - start + 1, period) for (start, period), last in paths.squares.items())
    return sorted((s, n, p) for s, n, p in found if n >= max(least, times * p))


def stretches(words: Words, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(text, first, end): stretches of words that hold all runs, by text."""
    window = least * (times - 2) // times + 1
    twice = np.concatenate([[False], words.repeated_windows(window), [False]])
    edges = np.flatnonzero(twice[1:] != twice[:-1])
    for first, end in edges.reshape(-1, 2).tolist():
        # windows that start in first .. end - 1; a stretch may go on from one text into the next
        while first < end:
            text = int(np.searchsorted(words.starts, first, "right")) - 1
            stop = min(end, int(words.starts[text + 1]))
            if stop - first + window - 1 >= least:
                begin = int(words.starts[text])
                yield text, first - begin, stop - begin + window - 1
            first = stop


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def find_runs(rows: DataFrame, column: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """rows without the text, with runs and collapsed: the runs of its words, and the words left joined by one space.

    runs has (start, length, period) by start, then period: stretches of words with a smallest period
    that no neighbouring word extends, of at least `least` words and `times` periods. collapsed is the
    text without the words that a run holds after its first period. A null text has no words: runs and
    collapsed are empty. Rows are independent, so repeated ones and empty tables need nothing more.
    Columns named runs or collapsed, in any case, are an error.
    """
    if times < 3 or least < times:
        raise ValueError("runs need three periods and a word for each at least")
    others = [f for f in rows.schema.fields if f.name != column]
    if any(unused(n, rows) != n for n in ("runs", "collapsed")):
        raise ValueError("rows have a column runs or collapsed")
    schema = T.StructType([*others, T.StructField("runs", RUNS, False), T.StructField("collapsed", T.StringType(), False)])
    names = [f.name for f in others]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = Words(text_bytes(part.column(part.schema.get_field_index(column))))
            runs: list[list[tuple[int, int, int]]] = [[] for _ in texts.of]
            for text, first, end in stretches(texts, least, times):
                runs[text] += [(first + s, n, p) for s, n, p in runs_of(texts.of[text][first:end], least, times)]
            left = [b" ".join(without_repeats(w, r)) for w, r in zip(texts.of, runs, strict=True)]
            kind = pa.list_(pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")]))
            made = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found in runs], kind)
            columns = [part.column(part.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, made, pa.array(left, pa.binary()).cast(pa.string())], [*names, "runs", "collapsed"])

    return rows.mapInArrow(work, schema)
