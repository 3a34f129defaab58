"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text is lower-cased and all ASCII characters but letters become spaces. Its features are the
subwords of 2 to 4 bytes, with the spaces at both ends of a word, hashed into buckets. Each bucket
has an embedding; the text's vector is the average over its subwords, and a linear softmax gives
the languages' probabilities. Everything is trained by stochastic gradient descent in numpy on a
bounded sample of labelled rows; a held-back part of that sample sets the temperature and the
probability below which a prediction is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphwright.llm.words import slices

SUBWORDS = (2, 3, 4)
BUCKET_BITS = 14
DIMENSIONS = 16
EPOCHS = 6
RATE = 0.5
#: Bytes of a text that are worked on at once.
BLOCK = 1 << 20
#: Of the sample, every so manieth row is held back for the calibration.
HELD_BACK = 5
#: Share of right predictions that accepted ones must reach in the calibration.
WANTED = 0.995

_SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


@dataclass
class Sampling:
    """Bounds of the training sample: languages, rows of each, characters of each row."""

    languages: int = 64
    rows: int = 800
    characters: int = 1500


@dataclass
class LanguageModel:
    """Scores of each bucket for each language, with what the calibration found."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, text: str) -> np.ndarray:
        """Calibrated probabilities of the languages."""
        counts = subword_counts(text)
        total = max(1.0, counts.sum())
        logits = (counts @ self.scores / total + self.bias) / self.temperature
        odds = np.exp(logits - logits.max())
        return odds / odds.sum()


def subword_counts(text: str) -> np.ndarray:
    """How often each bucket's subwords occur in the whole text."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_SPACED) + b" ", np.uint8)
    counts = np.zeros(1 << BUCKET_BITS)
    for at in range(0, len(raw), BLOCK):
        piece = raw[at : at + BLOCK + max(SUBWORDS) - 1]
        letter = piece != 32
        wide = piece.astype(np.uint32)
        for n in SUBWORDS:
            starts = min(BLOCK, len(piece) - n + 1)
            if starts <= 0:
                continue
            code = wide[:starts].copy()
            for j in range(1, n):
                code = (code << np.uint32(8)) | wide[j : j + starts]
            inside = letter[1 : 1 + starts].copy() if n > 2 else letter[:starts] | letter[1 : 1 + starts]
            for j in range(2, n - 1):
                inside &= letter[j : j + starts]
            code = (code[inside] + np.uint32(n * 0x9E37)) * np.uint32(2654435761)
            counts += np.bincount(code >> np.uint32(32 - BUCKET_BITS), minlength=1 << BUCKET_BITS)
    return counts


def slopes(embeddings: np.ndarray, share: np.ndarray, weights: np.ndarray, bias: np.ndarray, gold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slopes of one text's log loss by the embeddings of its subwords, the weights and the bias.

    share is each subword's share of the text, so share @ embeddings is their average.
    """
    vector = share @ embeddings
    logits = weights @ vector + bias
    error = np.exp(logits - logits.max())
    error /= error.sum()
    error[gold] -= 1
    return np.outer(share, weights.T @ error), np.outer(error, vector), error


def fit(texts: list[str], labels: list[str]) -> LanguageModel | None:
    """A model of labelled texts, or None without any."""
    languages = sorted(set(labels))
    if not languages:
        return None
    gold = np.array([languages.index(label) for label in labels])
    rows = []
    for text in texts:
        counts = subword_counts(text)
        used = np.flatnonzero(counts)
        rows.append((used, (counts[used] / max(1.0, counts.sum())).astype(np.float32)))
    rng = np.random.default_rng(7)
    table = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    weights = np.zeros((len(languages), DIMENSIONS), np.float32)
    weights[:] = rng.normal(0, 0.3, weights.shape)
    bias = np.zeros(len(languages), np.float32)
    held = np.arange(len(rows)) % HELD_BACK == 0 if len(rows) >= 10 * HELD_BACK else np.zeros(len(rows), bool)
    train = np.flatnonzero(~held)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(train):
            used, share = rows[i]
            rows_of, whole, start = slopes(table[used], share, weights, bias, gold[i])
            weights -= rate * whole
            bias -= rate * 0.1 * start
            table[used] -= rate * 20 * rows_of
    scores = table @ weights.T
    check = np.flatnonzero(held) if held.any() else train
    logits = np.array([share @ scores[used] + bias for used, share in (rows[i] for i in check)])
    temperature = _temperature(logits, gold[check])
    odds = np.exp((logits - logits.max(1, keepdims=True)) / temperature)
    odds /= odds.sum(1, keepdims=True)
    threshold = _threshold(odds.max(1), odds.argmax(1) == gold[check])
    return LanguageModel(languages, scores.astype(np.float32), bias, temperature, threshold)


def _temperature(logits: np.ndarray, gold: np.ndarray) -> float:
    """The divisor of the logits with the least log loss."""
    best = (np.inf, 1.0)
    for t in np.geomspace(0.25, 8, 41):
        z = logits / t
        z = z - z.max(1, keepdims=True)
        loss = float((np.log(np.exp(z).sum(1)) - z[np.arange(len(gold)), gold]).mean())
        best = min(best, (loss, float(t)))
    return best[1]


def _threshold(scores: np.ndarray, right: np.ndarray) -> float:
    """The least score from which on predictions are right as often as wanted."""
    order = np.argsort(-scores)
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(share >= WANTED)
    return float(scores[order][good[-1]]) if len(good) else 1.0


def training_sample(labelled: DataFrame, sampling: Sampling, *, key: str, text: str, lang: str) -> tuple[list[str], list[str]]:
    """Texts and languages of at most languages * rows rows, each a stretch of some characters.

    Of each language the rows that come first by a hash of id and text are chosen, and the place of
    the stretch follows from another hash, so reruns agree. All languages are learned; more than
    sampling.languages are an error, since the sample is bounded. At most 154 MB by default.
    """
    known = labelled.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    draw = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(1 << 30))
    counts = known.groupBy(lang).count().orderBy(lang).limit(sampling.languages + 1).collect()
    if len(counts) > sampling.languages:
        raise ValueError(f"more than {sampling.languages} languages: raise Sampling.languages")
    # twice the share that is wanted on average, of which the first by hash are kept below
    chosen = F.lit(False)
    for row in counts:
        share = min(1.0, 2 * sampling.rows / row["count"])
        chosen = chosen | ((F.col(lang) == row[0]) & (draw < int(share * (1 << 30))))
    size = F.greatest(F.length(text) - F.lit(sampling.characters), F.lit(0))
    start = F.pmod(F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(1)), 2), size + 1).cast("int") + 1
    sample = known.filter(chosen).select(draw.alias("d"), F.substring(F.col(text), start, F.lit(sampling.characters)).alias("t"), F.col(lang).alias("l")).distinct()
    first = Window.partitionBy("l").orderBy("d", "t")
    rows = sample.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= sampling.rows).collect()
    rows.sort(key=lambda r: (r["d"], r["l"], r["t"]))
    return [r["t"] for r in rows], [r["l"] for r in rows]


def identify(
    docs: DataFrame,
    labelled: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sampling: Sampling | None = None,
    keep: tuple[Column, ...] = (),
) -> DataFrame:
    """(key, keep.., lang_pred, score, rejected) for each row of docs, learned from labelled(key, text, lang).

    The whole text is scored. lang_pred is a learned language, or und for texts without a letter and
    null texts (score 0, rejected), as for all texts when nothing could be learned. rejected says
    that the score is below the calibrated threshold. Repeated rows give repeated results.
    """
    model = fit(*training_sample(labelled, sampling or Sampling(), key=key, text=text, lang=lang))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, scores, rejected = [], [], []
            for t in batch.column("_text").to_pylist():
                if model is None or not t or not any(map(str.isalpha, t)):
                    names.append("und")
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                p = model.probabilities(t)
                best = int(p.argmax())
                names.append(model.languages[best])
                scores.append(float(p[best]))
                rejected.append(bool(p[best] < model.threshold))
            kept = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(names), pa.array(scores, pa.float64()), pa.array(rejected)],
                names=[*kept, "lang_pred", "score", "rejected"],
            )

    slim = docs.select(F.col(key), *keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "_text")
    return slim.mapInArrow(judged, schema + ", lang_pred string, score double, rejected boolean")
