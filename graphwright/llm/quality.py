"""Quality by weak supervision: rules vote or abstain, and expectation-maximisation weighs them.

Each rule looks at counts of a whole text and votes 1 (good), -1 (bad) or 0 (abstains). Its votes
are right with two unknown accuracies, one on good texts and one on bad ones, independent of other
rules given the quality; whether it abstains tells nothing. A rule that knows one kind of bad text
has a low accuracy on bad texts and a high one on good ones, so its bad votes weigh much and its
good votes little. Accuracies and the share of good texts are estimated by expectation-maximisation
over how many texts have each pattern of votes. There are at most 3 ** rules patterns, whatever the
input, so the counts reach the driver and the estimate covers all texts. The posterior probability
of being good then decides, not each rule alone.

Null texts count as empty: no words, no votes but those for nothing; repeated rows count as often
as they are there. Without texts the model is its prior.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphwright.llm.words import Words, slices, text_bytes, unused

#: Words of a window that counts as repeated.
WINDOW = 5

#: Classes of bytes that are counted; the first two add up to the code points in words.
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Words of ASCII marks alone, and words with a symbol in them.
_BARE, _MARKED = re.compile(rb"[!-/:-@\[-`{-~]+"), re.compile(rb"[#*$%&|<>]")


def _class(*values: int) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(values)] = 1
    return table


#: Counts of characters by the bytes that begin them.
CHARACTERS = {
    "word_chars": _class(*[b for b in range(256) if b not in _SPACE and b & 0xC0 != 0x80]),
    "n_symbols": _class(*b"#*$%&|<>"),
    "n_upper": _class(*range(ord("A"), ord("Z") + 1)),
    "n_letters": _class(*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0xC3, 0xF5)),
    "n_digits": _class(*b"0123456789"),
    "n_shouts": _class(*b"!?"),
}
FEATURES = ("n_words", *CHARACTERS, "n_lines", "n_dup_lines", "n_repeat_words", "n_same_words", "n_distinct_words", "n_bare_words", "n_marked_words")


def _features(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    words = Words(texts)
    n = len(texts)
    ends = np.cumsum([len(t or b"") for t in texts])
    data = np.frombuffer(b"".join(t or b"" for t in texts), np.uint8)
    out = {"n_words": words.counts}

    def summed(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], ends])])

    for name, table in CHARACTERS.items():
        out[name] = summed(table[data], ends)
    lines = [[line for line in (t or b"").split(b"\n") if line.strip()] for t in texts]
    out["n_lines"] = np.fromiter(map(len, lines), np.int64, n)
    out["n_dup_lines"] = out["n_lines"] - np.fromiter((len(set(found)) for found in lines), np.int64, n)
    # a word is in a repeated window if one begins at it or at one of the few before it
    covered = begins = words.repeated_windows(WINDOW)
    for i in range(1, WINDOW):
        covered = covered | np.concatenate([np.zeros(min(i, len(begins)), bool), begins[: max(0, len(begins) - i)]])
    out["n_repeat_words"] = summed(covered, words.starts[1:])
    text = words.text_of()
    same = np.zeros(len(text), bool)
    same[1:] = (words.numbers[1:] == words.numbers[:-1]) & (text[1:] == text[:-1])
    out["n_same_words"] = summed(same, words.starts[1:])
    bare, marked = (np.fromiter((bool(test(w)) for w in words.distinct), bool, len(words.distinct)) for test in (_BARE.fullmatch, _MARKED.search))
    out["n_bare_words"], out["n_marked_words"] = (summed(kind[words.numbers], words.starts[1:]) for kind in (bare, marked & ~bare))
    out["n_distinct_words"] = np.fromiter((len(set(w)) for w in words.of), np.int64, n)
    return out


def with_features(rows: DataFrame, column: str = "text") -> DataFrame:
    """rows without the text, with the counts of FEATURES as longs.

    n_repeat_words are the words in windows of five that a text has twice or more. Columns of rows
    named like a count, in any case, are an error.
    """
    if any(unused(n, rows) != n for n in FEATURES):
        raise ValueError("rows have a column named like a count")
    names = [f.name for f in rows.schema.fields if f.name != column]
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != column], *[T.StructField(n, T.LongType(), False) for n in FEATURES]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            at = part.schema.get_field_index
            counts = _features(text_bytes(part.column(at(column))))
            columns = [*[part.column(at(n)) for n in names], *[pa.array(counts[n].astype(np.int64)) for n in FEATURES]]
            yield pa.RecordBatch.from_arrays(columns, [*names, *FEATURES])

    return rows.mapInArrow(work, schema)


def _share(part: str, whole: str, bad: float, good: float) -> tuple[Column, Column]:
    """Bad if the share is above one bound, good if not above the other."""
    a, b = F.col(part).cast("double"), F.col(whole).cast("double")
    return a > bad * b, (b > 0) & (a <= good * b)


def rules() -> dict[str, tuple[Column, Column]]:
    """Rules by name: when each votes bad, and when it votes good if it does not."""
    words, chars = F.col("n_words"), F.col("word_chars").cast("double")
    known = F.col("n_letters") + F.col("n_digits")
    return {
        "length": ((words < 10) | (words > 100000), (words >= 20)),
        "symbols": _share("n_symbols", "n_words", 0.1, 0.01),
        "word_length": ((chars < 2.5 * words) | (chars > 12 * words), (chars >= 3.5 * words) & (chars <= 8 * words)),
        "capitals": _share("n_upper", "n_letters", 0.2, 0.1),
        "letters": (known < 0.9 * chars, known >= 0.93 * chars),
        "bare_words": _share("n_bare_words", "n_words", 0.2, 0.02),
        "marked_words": _share("n_marked_words", "n_words", 0.2, 0.02),
        "digits": _share("n_digits", "word_chars", 0.2, 0.05),
        "shouts": _share("n_shouts", "n_words", 0.1, 0.02),
        "repeated_lines": _share("n_dup_lines", "n_lines", 0.3, 0.0),
        "repeated_windows": _share("n_repeat_words", "n_words", 0.15, 0.02),
        "stutter": _share("n_same_words", "n_words", 0.1, 0.02),
        "variety": ((words >= 50) & (F.col("n_distinct_words") < 0.15 * words), F.col("n_distinct_words") >= 0.3 * words),
    }


def votes() -> list[Column]:
    """Each rule's vote: 1, -1 or 0."""
    return [F.when(bad, -1).when(good, 1).otherwise(0).cast("byte").alias(name) for name, (bad, good) in rules().items()]


@dataclass(frozen=True)
class Prior:
    """What is believed before any text, worth a share of all texts, and when the estimate stops.

    As it is a share, the estimate is the same for a corpus and for ten copies of it.
    """

    on_good: float = 0.98
    on_bad: float = 0.3
    good: float = 0.85
    weight: float = 0.1
    rounds: int = 500
    tolerance: float = 1e-9


@dataclass(frozen=True)
class QualityModel:
    """(accuracy on good texts, on bad ones) of each rule by name, and the share of good texts."""

    accuracies: dict[str, tuple[float, float]]
    good: float

    def posterior(self) -> Column:
        """The probability that a text with votes in columns of the rules' names is good."""
        odds = F.lit(float(np.log(self.good / (1 - self.good))))
        for name, (on_good, on_bad) in self.accuracies.items():
            up, down = np.log(on_good / (1 - on_bad)), np.log((1 - on_good) / on_bad)
            odds = odds + F.when(F.col(name) > 0, float(up)).when(F.col(name) < 0, float(down)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def estimate(patterns: np.ndarray, counts: np.ndarray, prior: Prior = Prior()) -> tuple[np.ndarray, np.ndarray, float]:
    """(accuracies on good texts, on bad texts, share of good texts) from patterns of votes and how many texts have each.

    Both steps of a round use all patterns; the prior's votes and texts keep estimates within 0 and 1
    and say which side is good.
    """
    up, down = (patterns > 0).astype(float), (patterns < 0).astype(float)
    rules = patterns.shape[1]
    on_good, on_bad, good = np.full(rules, prior.on_good), np.full(rules, prior.on_bad), prior.good
    extra = prior.weight * counts.sum() + 1
    for _ in range(prior.rounds):
        odds = np.log(good / (1 - good)) + up @ np.log(on_good / (1 - on_bad)) + down @ np.log((1 - on_good) / on_bad)
        p = 1 / (1 + np.exp(-odds))
        well, ill = p * counts, (1 - p) * counts
        new_good = (well @ up + prior.on_good * extra) / (well @ (up + down) + extra)
        new_bad = (ill @ down + prior.on_bad * extra) / (ill @ (up + down) + extra)
        share = float((well.sum() + prior.good * extra) / (counts.sum() + extra))
        moved = max(np.abs(new_good - on_good).max(initial=0), np.abs(new_bad - on_bad).max(initial=0), abs(share - good))
        on_good, on_bad, good = new_good, new_bad, share
        if moved < prior.tolerance:
            break
    return on_good, on_bad, good


def fit_quality(featured: DataFrame, prior: Prior = Prior()) -> QualityModel:
    """The model of all rows with the counts of FEATURES."""
    names = list(rules())
    counted = featured.select(*votes()).groupBy(*names).agg(F.count(F.lit(1)).alias("texts")).orderBy(*names).toArrow()
    patterns = np.stack([counted.column(n).to_numpy() for n in names], axis=1).astype(np.float64)
    on_good, on_bad, good = estimate(patterns, counted.column("texts").to_numpy().astype(np.float64), prior)
    return QualityModel(dict(zip(names, zip(on_good.tolist(), on_bad.tolist(), strict=True), strict=True)), good)


def judge_quality(featured: DataFrame, model: QualityModel) -> DataFrame:
    """featured with votes, a struct of each rule's vote, and quality, the posterior probability of being good."""
    names = list(model.accuracies)
    by_name = {n: v for n, v in zip(rules(), votes(), strict=True)}
    judged = featured.withColumn("votes", F.struct(*[by_name[n] for n in names]))
    return judged.select("*", "votes.*").withColumn("quality", model.posterior()).drop(*names)
