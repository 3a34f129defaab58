"""Document fingerprints by consistent weighted sampling.

A text is a bag of lower-case words; a word's weight is how often it occurs. For each of SAMPLES
independent draws every word has its own gamma(2,1) variables r and c and a uniform b, all of which
follow from a 64-bit hash of the word and the number of the draw. With weight w,
t = floor(ln w / r + b), and the word with the least ln c - r (t - b) - r is the sample, together
with t. Two texts have the same sample with a probability that equals the generalised Jaccard
similarity of their weights, sum of minima over sum of maxima, so the share of equal samples
estimates it. Words are never folded together: texts without a common word share samples only by
collisions of 16 bits.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.llm.words import WordTable, slices

SAMPLES = 64
#: Words of a text that are drawn from at once.
BLOCK = 4096
#: Words whose keys at weight 1, and whose variables, a task remembers: 34 and 13 MB for 64 samples.
REMEMBERED_KEYS, REMEMBERED = 1 << 17, 1 << 14
#: Ranges of ids for each shuffle partition.
RANGES = 4

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """64 random-looking bits of each number (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(bits: np.ndarray) -> np.ndarray:
    """A number between 0 and 1, never 0 or 1, of each number of 23 bits."""
    return (bits.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-23)


class Sampler:
    """Draws for words, from a fixed seed."""

    def __init__(self, samples: int = SAMPLES, seed: int = 5) -> None:
        self.samples, self.seed = samples, seed
        #: two numbers of 64 bits for each draw
        self.streams = (np.arange(1, 2 * samples + 1, dtype=np.uint64) * _STEP).reshape(2, samples)
        size = lambda n: max(4 * BLOCK, n * SAMPLES // samples)
        self.once, self.more = WordTable(size(REMEMBERED_KEYS), self.keys), WordTable(size(REMEMBERED), self.variables)

    def variables(self, words: list[str]) -> list[np.ndarray]:
        """(codes, r, ln c, b): 64 bits for each word, and the variables of each word and draw."""
        codes = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(self.seed)), np.uint64, len(words))
        one, two = (mixed(codes[:, None] + stream) for stream in self.streams)
        low, up = np.uint64(0x7FFFFF), np.uint64(23)
        # gamma(2,1): minus the log of two uniforms' product
        r = -np.log(uniform(one & low) * uniform((one >> up) & low))
        log_c = np.log(-np.log(uniform(two & low) * uniform((two >> up) & low)))
        return [codes, r, log_c, uniform(((one >> np.uint64(46)) << np.uint64(5)) | (two >> np.uint64(59)))]

    def keys(self, words: list[str]) -> list[np.ndarray]:
        """(codes, keys) at weight 1, where t is 0."""
        codes, r, log_c, b = self.variables(words)
        return [codes, log_c - r * (np.float32(1) - b)]

    def signature(self, text: str | None) -> np.ndarray:
        """One 16-bit sample for each draw; a text without words has the sample 0 everywhere."""
        bag = Counter((text or "").lower().split())
        single = [w for w, n in bag.items() if n == 1]
        several = [w for w, n in bag.items() if n > 1]
        logs = np.log(np.array([bag[w] for w in several], np.float32))[:, None]
        best = np.full(self.samples, np.inf, np.float32)
        out = np.zeros(self.samples, np.uint64)
        draws = np.arange(self.samples)
        for words, table in ((single, self.once), (several, self.more)):
            for at in range(0, len(words), BLOCK):
                (codes, *known), rows = table.rows(words[at : at + BLOCK])
                if table is self.once:
                    key = known[0][rows]
                    row = key.argmin(0)
                    times = np.zeros(self.samples, np.uint64)
                else:
                    r, log_c, b = (c[rows] for c in known)
                    t = np.floor(logs[at : at + BLOCK] / r + b)
                    key = log_c - r * (t - b + np.float32(1))
                    row = key.argmin(0)
                    times = t[row, draws].astype(np.int64).view(np.uint64)
                least = key[row, draws]
                sample = mixed(codes[rows[row]] + times * _STEP)
                wins = least < best
                out = np.where(wins, np.uint64(1) + sample % np.uint64(65535), out)
                best = np.where(wins, least, best)
        return out


def as_text(signature: np.ndarray) -> str:
    """Four hex digits for each sample."""
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of draws with the same sample."""
    return float((a == b).mean())


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by as many, or all, of the following text's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_ranges(docs: DataFrame, order: Column, tie: str, columns: list[Column]) -> DataFrame:
    """Rows in id ranges of about one size, each range in order and followed by the row that comes next.

    tie names the column that orders rows of one id. Adds _range, _order, _after (1 for the row lent from the next range; the last one lends from the
    first). Range borders are quantiles over all ids and are few; whole rows are shuffled once.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = partitions * RANGES
    rows = docs.select(*columns, order.alias("_order"))
    steps = [i / ranges for i in range(1, ranges)]
    ids = docs.select(order.alias("_order"))
    borders = ids.agg(F.percentile_approx("_order", F.lit(steps), F.lit(100 * ranges)).alias("q")).first()["q"]
    cuts = np.unique(np.array(borders or [], np.int64))

    @F.arrow_udf("int")
    def range_of(order: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, order.to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    firsts = sorted((r["_range"], r["first"]) for r in ids.select(range_of("_order").alias("_range"), "_order").groupBy("_range").agg(F.min("_order").alias("first")).collect())
    # the first id of each range, and the range before it, which borrows it
    lent = [(firsts[i][1], firsts[i - 1][0]) for i in range(len(firsts))]
    lent = spark.createDataFrame(lent, "_first long, _range int")
    placed = rows.withColumn("_range", range_of("_order")).withColumn("_after", F.lit(0))
    borrowed = rows.join(F.broadcast(lent), F.col("_order") == F.col("_first")).drop("_first").withColumn("_after", F.lit(1))
    both = placed.unionByName(borrowed)
    return both.repartition(partitions, "_range").sortWithinPartitions("_range", "_after", "_order", tie)


def fingerprint_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """For each row of docs: (key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The next document is the one with the next larger id; after the last comes the first, so a
    single document follows itself. Rows with one id are in the order of their texts; null ids come
    first; null texts count as empty. Equal texts have equal fingerprints; a text without words has
    the fingerprint of zeros, like any other such text. An empty table gives an empty result.
    """

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        waiting: tuple | None = None

        def finished(row: tuple, following: str, its_print: np.ndarray) -> tuple:
            _, doc_id, body, own = row
            changed = edited_text(body, following)
            other = sampler.signature(changed)
            digest = hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest()
            return doc_id, len(body), digest, as_text(own), as_text(other), likeness(own, other), likeness(own, its_print)

        for batch in slices(batches):
            out = []
            columns = [batch.column(c).to_pylist() for c in (key, "_text", "_range", "_after")]
            for doc_id, body, at, after in zip(*columns, strict=True):
                if after and (waiting is None or waiting[0] != at):
                    continue
                own = sampler.signature(body)
                if waiting is not None and waiting[0] == at:
                    out.append(finished(waiting, body, own))
                waiting = None if after else (at, doc_id, body, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int32() if kind == "int" else pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    body = F.coalesce(F.col(text), F.lit(""))
    order = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    rows = in_ranges(docs, order, "_text", [F.col(key), body.alias("_text")])
    schema = f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(printed, schema)
