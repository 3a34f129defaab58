"""Mixing sources to target weights by hash-threshold histograms; DataFrame functions only.

Every row has a fixed 36-bit hash of its id. Per source, sizes are summed by the first 12 bits; the
running sums show in which bucket the budget ends. Only that bucket is split by the next 12 bits,
then by the last 12. What results is one threshold per source, and the mix is a filter on the hash:
no sort, and nested budgets take nested sets of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphwright.llm.words import word_count
from graphwright.plans.checkpoints import cut

LEVEL_BITS = 12
LEVELS = 3
#: Thresholds of at most so many sources are broadcast; beyond it the join shuffles.
BROADCAST_SOURCES = 20_000
#: What mix_sources adds.
ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_passes")


def row_hash(id_column: Column) -> Column:
    """36 bits of the id's MD5 as a long; equal ids have equal hashes, null counts as empty text."""
    digits = F.substring(F.md5(F.coalesce(id_column.cast("string"), F.lit(""))), 1, 9)
    return F.conv(digits, 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], cap: int) -> DataFrame:
    """(source, source_size) -> plus weight and target.

    Sources in code point order, null last, take the weights in turn. They share
    share[0]/share[1] of all sizes by weight; a target stops at cap times its source's size, and
    the excess goes to the others by weight until none is above. Sources are put in the order of
    cap * size / weight: those that stop are a prefix, so one running sum finds the level.
    """
    up, down = share
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    sized = sizes.withColumn("weight", weight)
    by_ratio = Window.orderBy(F.col("source_size") * 1.0 / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    sized = (
        sized.withColumn("_stopped", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap)
        .withColumn("_open", F.sum("weight").over(after))
        .withColumn("_all", F.sum("source_size").over(everything))
        # level * down: what is left for the open sources, over their weights
        .withColumn("_left", F.col("_all") * up - F.col("_stopped") * down)
        .withColumn("_fits", F.col("_left").cast("double") * F.col("weight") <= F.col("source_size").cast("double") * F.col("_open") * (cap * down))
        .withColumn("_at", F.min(F.when(F.col("_fits"), F.struct(F.col("source_size") * 1.0 / F.col("weight"), F.col("_left"), F.col("_open")))).over(everything))
        .withColumn("_level", F.when(F.col("_at").isNotNull(), F.struct(F.col("_at._left").alias("left"), F.col("_at._open").alias("open"))))
    )
    target = F.when(
        F.col("_fits"),
        F.col("_level.left").cast("double") * F.col("weight") / (F.col("_level.open") * down).cast("double"),
    ).otherwise((F.col("source_size") * cap).cast("double"))
    return sized.select("source", "source_size", "weight", target.alias("target"))


def _budgeted(rows: DataFrame, weights: tuple[int, ...], share: tuple[int, int], cap: int) -> DataFrame:
    """Per source: source_size, target, full (whole passes), rest (what a further pass may take), threshold."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = cut(
        source_targets(sizes, weights, share, cap)
        .withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    )
    small = plan.count() <= BROADCAST_SOURCES
    bounded = F.broadcast if small else (lambda df: df)
    # a source that its whole passes fill has no further pass, and no threshold to look for
    edge = plan.filter("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("before"))
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        known = edge.select(F.col("source").alias("_s"), F.col("rest").alias("_rest"), F.col("low").alias("_low"), F.col("before").alias("_before"))
        inside = rows.join(
            bounded(known),
            F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("_low")),
        )
        histogram = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(
            F.sum("size").alias("bucket_size"), F.max("_rest").alias("rest"), F.max("_before").alias("start")
        )
        running = Window.partitionBy("source").orderBy("bucket")
        histogram = histogram.withColumn("through", F.col("start") + F.sum("bucket_size").over(running))
        edge = (
            histogram.filter(F.col("through") > F.col("rest"))
            .groupBy("source", "rest")
            .agg(F.min(F.struct("bucket", "through", "bucket_size")).alias("e"))
            .select(
                "source", "rest", F.col("e.bucket").alias("low"),
                (F.col("e.through") - F.col("e.bucket_size")).alias("before"), F.col("e.through").alias("through"),
            )
        )
        edge = cut(edge)
    # The last bucket goes in if that brings the sum nearer to the budget.
    nearer = (F.col("through") - F.col("rest")) < (F.col("rest") - F.col("before"))
    ends = edge.select(F.col("source").alias("_s"), (F.col("low") + nearer.cast("long")).alias("threshold"))
    whole = F.lit(1 << (LEVEL_BITS * LEVELS)).cast("long")
    out = plan.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        "source", "source_size", "target", "full",
        # no bucket passes the budget: the rest takes all, or there is nothing more to take
        F.coalesce("threshold", F.when(F.col("rest") > 0, whole).otherwise(F.lit(0))).alias("threshold"),
    )
    return bounded(out)


def mix_sources(
    docs: DataFrame,
    *,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    weights: tuple[int, ...] = (5, 2, 1),
    share: tuple[int, int] = (3, 2),
    cap: int = 2,
) -> DataFrame:
    """All rows of docs with mix_size, mix_source_size, mix_target and mix_passes (0 to cap).

    A row's size is its number of words, null texts having none. mix_passes says how often the mix
    takes the row; sizes times passes sum up to near the source's target, at most half a row (of
    rows with one hash) off it. Rows with the same id share a hash and are taken alike, so reruns
    agree and repeated rows stay together. A null source is a source of its own, in last place. An
    empty table gives an empty result; sources without words have target 0 and are not taken, nor
    are rows without words beyond whole passes of their source. All columns are kept but those of
    the four names, which are replaced.
    """
    slim = cut(docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"), row_hash(F.col(key)).alias("h")))
    ends = _budgeted(slim, weights, share, cap)
    # the rows' own columns get names that clash with none below, and theirs back at the end
    own = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(own)], F.col(source).alias("of"), word_count(F.col(text)).alias("mix_size"), row_hash(F.col(key)).alias("h"))
    joined = rows.join(ends, F.col("of").eqNullSafe(F.col("source")), "left")
    passes = F.col("full") + (F.col("h") < F.col("threshold")).cast("long")
    return joined.select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(own)], "mix_size", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), passes.alias("mix_passes"))


def materialised(docs: DataFrame, *, text: str = "text", source: str = "source", key: str = "doc_id", **options: object) -> DataFrame:
    """The mix itself: the columns of docs, whatever their names, each row as often as the mix takes it."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"), F.col(source).alias("source"), F.col(key).alias("id"))
    mixed = mix_sources(packed, text="text", source="source", key="id", **options)
    times = F.sequence(F.lit(1).cast("long"), F.col("mix_passes"))
    return mixed.filter("mix_passes > 0").select("row", F.explode(times)).select("row.*")
