"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic rows are the positives; all other text counts as unlabelled, whatever its label.
With the class prior p, the risk of a score f is

    p * loss(f on positives as toxic)
    + max(0, loss(f on unlabelled as clean) - p * loss(f on positives as clean))

where the second part can only turn negative by overfitting and then has no slope. Steps get
smaller, and the model is the mean over the second half of them. The score is linear in counts of
features of a text's distinct words: the word itself, its pieces of 4 and 5 characters with the
word's ends marked. Features are hashed; those whose shares among positives and unlabelled text
differ most are used. Training is numpy on a bounded sample. Features of many words are hashed at
once, from their code points, so nothing has to be remembered between texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.llm.words import SLICE_ROWS, slices
from graphwright.plans.checkpoints import cut

#: A word for this purpose: a run of letters.
LETTERS = re.compile(r"[^\W\d_]+")
PIECES = (4, 5)
BUCKETS = 1 << 20
EPOCHS = 40
BATCH = 512
RATE = 0.1
DECAY = 1e-3
#: Features that are used however few positives there are; else one for two positives, up to a bound.
FEW_FEATURES = 200
#: Characters of words that are hashed at once, about; a longer word is hashed alone.
BLOCK = 1 << 17


@dataclass
class Sampling:
    """Bounds of the training sample: positive rows, unlabelled rows, features."""

    positives: int = 4000
    unlabelled: int = 8000
    features: int = 800


@dataclass
class ToxicityModel:
    """Weights of the used buckets, and the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) for each feature of these lower-case words: numbers of the words in order, and hashes."""
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - starts[word]
    # a word: the sum of its characters' hashes, each by its place
    each = (codes + place.astype(np.uint64) * np.uint64(0x1000193)) * np.uint64(0x9E3779B97F4A7C15)
    whole = np.add.reduceat(each ^ (each >> np.uint64(29)), starts) if len(words) else each
    found, owners = [whole * np.uint64(0xBF58476D1CE4E5B9)], [np.arange(len(words))]
    for n in PIECES:
        at = np.flatnonzero(place <= lengths[word] - n)
        code = np.full(len(at), n, np.uint64)
        for j in range(n):
            code = code * np.uint64(0x100000001B3) + codes[at + j]
        found.append(code * np.uint64(0x9E3779B97F4A7C15))
        owners.append(word[at])
    return np.concatenate(owners), (np.concatenate(found) >> np.uint64(44)).astype(np.int64)


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of each feature of each text's distinct words, in blocks of about BLOCK characters."""
    words: list[str] = []
    owners: list[int] = []
    size = 0

    def flushed() -> tuple[np.ndarray, np.ndarray]:
        word, bucket = word_features(words)
        return np.array(owners)[word], bucket

    for i, text in enumerate(texts):
        own = list(dict.fromkeys(LETTERS.findall((text or "").lower())))
        words += own
        owners += [i] * len(own)
        size += len(text or "")
        if size >= BLOCK and words:
            yield flushed()
            words, owners, size = [], [], 0
    if words:
        yield flushed()


class Scorer:
    """Scores whole texts with a model."""

    def __init__(self, model: ToxicityModel) -> None:
        self.bias = model.bias
        self.weight = np.zeros(BUCKETS, np.float32)
        self.weight[model.buckets] = model.weights

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of being toxic, 0 to 1, of each text."""
        total = np.full(len(texts), self.bias)
        for text, bucket in features(texts):
            total += np.bincount(text, self.weight[bucket], len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def text_buckets(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its buckets, and how often its distinct words have each."""
    blocks = [f for f in features(texts)]
    text, bucket = (np.concatenate([np.zeros(0, np.int64), *(b[i] for b in blocks)]) for i in (0, 1))
    order = np.argsort(text, kind="stable")
    ends = np.searchsorted(text[order], np.arange(len(texts) + 1))
    for i in range(len(texts)):
        yield np.unique(bucket[order[ends[i] : ends[i + 1]]], return_counts=True)


def sigmoid(z: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-z)), without overflow."""
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def risk_and_slope(xp: np.ndarray, xu: np.ndarray, weights: np.ndarray, bias: float, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of positives xp and unlabelled rows xu, and its slope by the weights and the bias.

    The loss is the logistic one. The clean part is held at 0 where it is negative, and has no slope there.
    """
    fp, fu = xp @ weights + bias, xu @ weights + bias
    toxic = prior * np.logaddexp(0, -fp).mean()
    clean = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    gp, gu = -prior * sigmoid(-fp) / len(fp), np.zeros(len(fu))
    if clean >= 0:
        gp, gu = gp - prior * sigmoid(fp) / len(fp), sigmoid(fu) / len(fu)
    return float(toxic + max(0.0, clean)), np.append(xp.T @ gp + xu.T @ gu, gp.sum() + gu.sum())


def fit(counts: np.ndarray, positive: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk; counts has a row per text."""
    rng = np.random.default_rng(11)
    pos, unl = np.flatnonzero(positive), np.flatnonzero(~positive)
    model = np.append(np.zeros(counts.shape[1]), np.log(prior / (1 - prior)))
    first, second = np.zeros(len(model)), np.zeros(len(model))
    mean, kept, step = np.zeros(len(model)), 0, 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for some in np.array_split(rng.permutation(unl), max(1, len(unl) // BATCH)):
            mine = pos if len(pos) <= BATCH else rng.choice(pos, BATCH, replace=False)
            _, slope = risk_and_slope(counts[mine].astype(np.float64), counts[some].astype(np.float64), model[:-1], model[-1], prior)
            slope[:-1] += DECAY * model[:-1]
            step += 1
            first = 0.9 * first + 0.1 * slope
            second = 0.999 * second + 0.001 * slope * slope
            model -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            if epoch >= EPOCHS // 2:
                mean, kept = mean + model, kept + 1
    return mean[:-1] / kept, float(mean[-1] / kept)


def train(docs: DataFrame, labels: DataFrame, *, key: str, text: str, sampling: Sampling) -> ToxicityModel | None:
    """A model from labels(key, toxic) and the texts of docs, or None without toxic or other rows.

    Both are to hold training rows only. The prior is the share of toxic rows among all labels.
    """
    named = labels.filter(F.col(key).isNotNull() & F.col("toxic").isNotNull()).groupBy(key).agg(F.max("toxic").alias("toxic"))
    toxic, known = named.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    rows = docs.count()
    if not toxic or not rows:
        return None
    prior = min(max(toxic / known, 1e-3), 0.9)
    # the ids that come first by a hash, so that every run draws the same
    ids = named.filter("toxic = 1").select(F.col(key).alias("_id")).orderBy(F.xxhash64(key), key).limit(sampling.positives)
    chosen = docs.select(F.col(key), F.col(text).alias("_text")).join(F.broadcast(ids), F.col(key) == F.col("_id"), "left")
    # by text too, so that rows without an id are not drawn all or none
    take = F.pmod(F.xxhash64(F.col(key), F.col("_text"), F.lit(1)), F.lit(1 << 30)) < int(min(1.0, sampling.unlabelled / rows) * (1 << 30))
    sets = F.array_compact(F.array(F.when(F.col("_id").isNotNull(), F.lit(True)), F.when(take, F.lit(False))))
    sample = cut(chosen.withColumn("positive", F.explode(sets)).select("positive", F.col("_text").alias("text")))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), np.int32)
        texts = [0, 0]
        for batch in slices(batches, SLICE_ROWS // 8):
            positives, bodies = (c.to_pylist() for c in batch.columns)
            for positive, (found, _) in zip(positives, text_buckets(bodies), strict=True):
                seen[int(positive), found] += 1
                texts[int(positive)] += 1
        used = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1), pa.int64()), pa.array(np.append(seen[1][used], texts[1]), pa.int64()), pa.array(np.append(seen[0][used], texts[0]), pa.int64())],
            names=["bucket", "p", "u"],
        )

    shares = cut(sample.mapInArrow(counted, "bucket long, p long, u long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u")))
    _, n_p, n_u = shares.filter("bucket = -1").first()
    if not n_p or not n_u:
        return None
    a, b = (F.col("p") + 0.5) / (n_p + 1), (F.col("u") + 0.5) / (n_u + 1)
    apart = (a - b) / F.sqrt(a * (1 - a) / n_p + b * (1 - b) / n_u)
    best = shares.filter("bucket >= 0 and p >= 3").orderBy(F.desc(apart), "bucket").limit(min(sampling.features, max(FEW_FEATURES, n_p // 2)))
    buckets = np.array(sorted(r["bucket"] for r in best.collect()), np.int64)
    if not len(buckets):
        return None

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_ROWS // 8):
            at, counts = [], []
            for found, times in text_buckets(batch.column(1).to_pylist()):
                place = np.minimum(np.searchsorted(buckets, found), len(buckets) - 1)
                hit = buckets[place] == found
                at.append(place[hit].tolist())
                counts.append(np.minimum(times[hit], 255).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["positive", "at", "counts"]
            )

    drawn = sample.mapInArrow(vectors, "positive boolean, at array<int>, counts array<int>").orderBy(F.xxhash64("at", "counts"), "positive", "at", "counts")
    # as many as are drawn on average and then some; very many rows of one id come in part
    drawn = sorted(drawn.limit(2 * (sampling.positives + sampling.unlabelled)).collect(), key=lambda r: (r["positive"], r["at"], r["counts"]))
    table = np.zeros((len(drawn), len(buckets)), np.uint8)
    for i, row in enumerate(drawn):
        table[i, row["at"]] = row["counts"]
    weights, bias = fit(table, np.array([r["positive"] for r in drawn]), prior)
    return ToxicityModel(buckets, weights, bias)


def score_toxicity(
    docs: DataFrame,
    train_docs: DataFrame,
    train_labels: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    sampling: Sampling | None = None,
) -> DataFrame:
    """All columns of docs plus toxicity (0 to 1), learned from the training rows given.

    Whole texts are scored; empty and null texts get the score of no words. Without a toxic training
    row nothing is learned and every score is 0. Repeated rows give repeated results; repeated
    labels of an id count once, toxic if one of them is. A column named toxicity is replaced.
    """
    model = train(train_docs, train_labels, key=key, text=text, sampling=sampling or Sampling())

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model) if model else None
        for column in texts:
            values: list[float] = []
            for at in range(0, len(column), SLICE_ROWS):
                some = column.slice(at, SLICE_ROWS).to_pylist()
                values += scorer.scores(some).tolist() if scorer else [0.0] * len(some)
            yield pa.array(values, pa.float64())

    return docs.withColumn("toxicity", scored(F.col(text)))
