"""Expressions on whole texts that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: a run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Characters from which a word counts as long.
LONG = 64

#: Rows of a batch that are Python objects at the same time.
SLICE_ROWS = 256


def word_count(text: Column) -> Column:
    """Words of the whole text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_bytes(text: Column) -> Column:
    """Bytes of the text in UTF-8 as a long; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def id_fold(id_column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo a fold count; null ids count as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(id_column.cast("string"), F.lit("")), "utf-8")), F.lit(modulus))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Small slices of Arrow batches, so that few texts are Python strings at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def unused(name: str, *frames: DataFrame) -> str:
    """name, or with as many underscores before it as make it a column of none of the frames, whatever the case."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Bits of a window's hash that are compared before its words.
HASH_MASK = (1 << 64) - 1


class Words:
    """The words of some texts, as bytes and as numbers; equal words have equal numbers."""

    def __init__(self, texts: list[bytes | None]) -> None:
        # bytes are split at just the six ASCII white-space characters
        self.of = [t.split() if t else [] for t in texts]
        self.counts = np.fromiter(map(len, self.of), np.int64, len(self.of))
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        numbers: dict[bytes, int] = {}
        self.numbers = np.fromiter((numbers.setdefault(w, len(numbers)) for words in self.of for w in words), np.int64, int(self.starts[-1]))
        #: the word of each number
        self.distinct = list(numbers)

    def text_of(self) -> np.ndarray:
        """For each word the place of its text."""
        return np.repeat(np.arange(len(self.of)), self.counts)

    def repeated_windows(self, size: int) -> np.ndarray:
        """For each word whether the window of so many words from it on lies in its text and is there twice or more.

        Windows are sorted by a hash and compared with their neighbours as words, so this is exact.
        """
        out = np.zeros(len(self.numbers), bool)
        text = self.text_of()
        at = np.flatnonzero(text[: len(text) - size + 1] == text[size - 1 :]) if len(text) >= size else np.zeros(0, np.int64)
        if not len(at):
            return out
        numbers = self.numbers.astype(np.uint64)
        key = text[at].astype(np.uint64)
        for i in range(size):
            key = (key ^ numbers[at + i]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        key &= np.uint64(HASH_MASK)
        order = np.argsort(key)
        key, at = key[order], at[order]
        twins = np.flatnonzero(key[1:] == key[:-1])
        alike = text[at[twins]] == text[at[twins + 1]]
        for i in range(size):
            alike &= self.numbers[at[twins] + i] == self.numbers[at[twins + 1] + i]
        if alike.all():
            out[at[twins]] = out[at[twins + 1]] = True
            return out
        # two windows share a hash: those with such hashes are compared as they are
        clashing = np.isin(key, key[twins[~alike]])
        seen: dict[tuple[int, ...], list[int]] = {}
        for i in at[clashing].tolist():
            seen.setdefault((int(text[i]), *self.numbers[i : i + size].tolist()), []).append(i)
        for places in seen.values():
            out[places] = len(places) > 1
        sure = ~clashing[twins]
        out[at[twins[sure]]] = out[at[twins[sure] + 1]] = True
        return out


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow column in UTF-8."""
    return column.cast(pa.binary()).to_pylist()


#: A key with more than one in so many rows is hot; there are fewer than so many of them.
HOT = 1000


def spread_join(rows: DataFrame, labels: DataFrame, on: list[str], count: str) -> DataFrame:
    """rows with the columns of labels, which has each key once and in count how many rows have it.

    Hot keys, fewer than HOT, are broadcast, so their rows stay where they are; the others are
    shuffled. Both tables are read twice. Rows without a label are left out.
    """
    total = labels.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(labels.filter(F.col(count) * HOT > total))
    others = rows.join(hot.select(*on), on, "left_anti").join(labels.filter(F.col(count) * HOT <= total), on)
    return rows.join(hot, on).unionByName(others)


class WordTable:
    """Rows of numbers for words, made when first needed; a bounded number of them is remembered.

    When the table is full, the half that was used most often stays. What is remembered decides how
    long a row takes, never what is in it.
    """

    def __init__(self, capacity: int, make: Callable[[list[str]], list[np.ndarray]]) -> None:
        self.capacity, self.make = capacity, make
        self.ids: dict[str, int] = {}
        self.used = np.zeros(capacity, np.int64)
        self.columns: list[np.ndarray] = []

    def rows(self, words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """The columns of make, and each word's row in them; at most capacity / 2 distinct words.

        The columns are the table's own; they hold until the next call. Words of more than LONG
        characters are remembered by their hash.
        """
        at, new = self._found(words)
        whole = {}
        if max(map(len, new), default=0) > LONG:
            names = {w: f"\0{xxhash.xxh3_128_hexdigest(w.encode('utf-8', 'replace'))}" for w in new if len(w) > LONG}
            whole = {name: w for w, name in names.items()}
            words = [names.get(w, w) for w in words]
            at, new = self._found(words)
        if len(self.ids) + len(new) > self.capacity:
            self._halve()
            at, new = self._found(words)
        if new or not self.columns:
            made = self.make([whole.get(w, w) for w in new])
            if not self.columns:
                self.columns = [np.zeros((self.capacity, *m.shape[1:]), m.dtype) for m in made]
            slots = np.arange(len(self.ids), len(self.ids) + len(new))
            for column, fresh in zip(self.columns, made, strict=True):
                column[slots] = fresh
            self.used[slots] = 0
            self.ids.update(zip(new, slots.tolist(), strict=True))
            at, _ = self._found(words)
        self.used[at] += 1
        return self.columns, at

    def _found(self, words: list[str]) -> tuple[np.ndarray, list[str]]:
        """Each word's row or -1, and the distinct words without one."""
        at = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        return at, list(dict.fromkeys([words[i] for i in np.flatnonzero(at < 0).tolist()]))

    def _halve(self) -> None:
        stay = np.sort(np.argsort(-self.used[: len(self.ids)], kind="stable")[: self.capacity // 2])
        words = list(self.ids)  # in the order of their rows
        for column in self.columns:
            column[: len(stay)] = column[stay]
        self.used[: len(stay)] = self.used[stay] // 2
        self.used[len(stay) :] = 0
        self.ids = {words[old]: i for i, old in enumerate(stay.tolist())}
