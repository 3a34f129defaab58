"""URL filtering by dated lists: validity intervals and an as-of join; DataFrame functions only.

List entries are dated: a pattern is added to a list at one time and removed at another. They become
intervals, and every capture is held against the entries that were active when it was fetched.
Patterns are hosts (which cover their subdomains) or hosts with a path (which cover what lies
below). A capture is looked up under each suffix of its host and each prefix of its path, so the
join is an equality on the pattern plus the interval condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entries are repeated so often, and captures spread over as many groups, so that one pattern that
#: covers a large part of all captures does not meet in one task.
SALTS = 16

#: Scheme, user, host, port and path of a URL; the groups 1 and 2 are host and path.
URL = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)"


def url_host(url: Column) -> Column:
    """Lower-case host without a final dot; empty for what isn't an absolute URL."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, URL, 1)), r"\.$", "")


def url_path(url: Column) -> Column:
    """Path without query and fragment, without slashes at its end."""
    return F.regexp_replace(F.regexp_extract(url, URL, 2), r"/+$", "")


def lookup_keys(url: Column) -> Column:
    """All patterns that cover a URL: suffixes of its host, and its host with each prefix of its path."""
    labels = F.split(url_host(url), r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    parts = F.split(url_path(url), "/")
    below = F.when(
        F.size(parts) > 1,
        F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.concat(url_host(url), F.array_join(F.slice(parts, F.lit(1), i), "/"))),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(url_host(url) == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.concat(suffixes, below))
    )


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, action, effective) -> (list, pattern, valid_from, valid_to), valid_to exclusive or null.

    The latest entry of a list and pattern holds until the next one; of entries with one time, a
    removal counts. Rows with a null pattern or time are ignored.
    """
    known = entries.filter("pattern is not null and effective is not null").groupBy("list", "pattern", "effective").agg(
        F.min(F.when(F.col("action") == "add", 1).otherwise(0)).alias("on")
    )
    steps = Window.partitionBy("list", "pattern").orderBy("effective")
    return (
        known.withColumn("valid_to", F.lead("effective").over(steps))
        .filter("`on` = 1")
        .select("list", "pattern", F.col("effective").alias("valid_from"), "valid_to")
    )


def filter_urls(captures: DataFrame, entries: DataFrame, *, salts: int = SALTS) -> DataFrame:
    """captures(page_id, url, fetched) -> plus active_entries, list, pattern, listed_since, blocked.

    entries(list, pattern, action, effective); fetched and effective are of one orderable type. The
    most specific active entry is reported: the longest pattern, then the earliest list by name.
    Each capture row gives one row; repeated captures are counted before the shuffle and given back
    after it. A null or relative URL, and a capture without a time, match nothing and pass. Without
    entries nothing is blocked; further columns of either table are ignored.
    """
    counted = captures.groupBy("page_id", "url", "fetched").agg(F.count(F.lit(1)).alias("copies"))
    salt = F.pmod(F.xxhash64("page_id", "url", "fetched"), F.lit(salts)).cast("int")
    keyed = counted.withColumn("salt", salt).withColumn("pattern", F.explode_outer(lookup_keys(F.col("url"))))
    spans = validity_intervals(entries).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spans = spans.select(F.col("pattern").alias("p"), F.col("salt").alias("s"), "list", "valid_from", "valid_to")
    active = (
        (F.col("pattern") == F.col("p"))
        & (F.col("salt") == F.col("s"))
        & (F.col("valid_from") <= F.col("fetched"))
        & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    )
    order = F.struct((-F.length("p")).alias("n"), "list", "p", "valid_from")
    return (
        keyed.join(spans, active, "left")
        .groupBy("page_id", "url", "fetched", "copies")
        .agg(F.count("p").alias("active_entries"), F.min(F.when(F.col("p").isNotNull(), order)).alias("best"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(
            "page_id", "url", "fetched", "active_entries",
            F.col("best.list").alias("list"), F.col("best.p").alias("pattern"), F.col("best.valid_from").alias("listed_since"),
            (F.col("active_entries") > 0).alias("blocked"),
        )
    )
