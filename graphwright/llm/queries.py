"""The registered queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphwright.llm.chat_format import conversation_digests, reconstruct
from graphwright.llm.decontaminate import find_leaks
from graphwright.llm.fingerprint import fingerprint_documents
from graphwright.llm.language_id import identify
from graphwright.llm.manifest import build_manifest, encoded, folded, hashed, proof_hash
from graphwright.llm.mixing import mix_sources
from graphwright.llm.periodic_runs import find_runs
from graphwright.llm.quality import fit_quality, judge_quality, with_features
from graphwright.llm.sharding import shard_rows
from graphwright.llm.simhash import simhash_groups
from graphwright.llm.token_count import count_tokens
from graphwright.llm.toxicity import score_toxicity
from graphwright.llm.url_filter import filter_urls, url_host, url_path
from graphwright.llm.words import WORD, id_fold, utf8_bytes
from graphwright.plans.checkpoints import cut
from graphwright.sources.tables import read_table

#: Words in host names that put a host on the derived list of op1.
LISTED_WORDS = "casino|bets|pills|spam|adult|ads-"
#: Start and length of the period over which captures and entries of op1 are spread, in seconds.
PERIOD_START, PERIOD = 1704067200, 30 * 86400


def derived_entries(pages: DataFrame) -> DataFrame:
    """Dated entries that follow from the pages: hosts with telling names, and one URL in sixteen.

    Dates come from the pattern's MD5. Some entries are removed again, some of these added again.
    """
    located = pages.select(url_host(F.col("url")).alias("host"), F.concat(url_host(F.col("url")), url_path(F.col("url"))).alias("whole"))
    located = located.filter("host <> ''")
    number = F.conv(F.substring(F.md5(F.col("pattern")), 1, 8), 16, 10).cast("long")
    hosts = located.filter(F.col("host").rlike(LISTED_WORDS)).select(
        F.lit("hosts").alias("list"), F.regexp_replace("host", r"^(www|m|blog)\.", "").alias("pattern")
    )
    urls = located.select(F.lit("urls").alias("list"), F.col("whole").alias("pattern")).filter(F.pmod(number, F.lit(16)) == 0)
    patterns = hosts.unionByName(urls).distinct().withColumn("n", number)
    added = F.lit(PERIOD_START) + F.pmod(F.col("n"), F.lit(PERIOD))
    steps = F.array(
        F.struct(F.lit("add").alias("action"), added.alias("effective")),
        F.when(F.pmod("n", F.lit(3)) == 0, F.struct(F.lit("remove").alias("action"), (added + 5 * 86400).alias("effective"))),
        F.when(F.pmod("n", F.lit(6)) == 0, F.struct(F.lit("add").alias("action"), (added + 8 * 86400).alias("effective"))),
    )
    return patterns.select("list", "pattern", F.explode(F.array_compact(steps)).alias("step")).select("list", "pattern", "step.action", "step.effective")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL, fetched at a time that follows from its id, against the derived dated lists."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.lit(PERIOD_START) + F.pmod(F.col("page_id") * 7919, F.lit(PERIOD))
    captures = pages.withColumn("fetched", fetched)
    return filter_urls(captures, derived_entries(pages))


OP1_SQL = rf"""
with located as (
  select page_id, url, {PERIOD_START} + (page_id * 7919) % {PERIOD} as fetched,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)', 1)), '\.$', '') as host,
    regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)', 2), '/+$', '') as path
  from pages
), patterns as (
  select list, pattern, ('0x' || substr(md5(pattern), 1, 8))::bigint as n from (
    select 'hosts' as list, regexp_replace(host, '^(www|m|blog)\.', '') as pattern from located where regexp_matches(host, '{LISTED_WORDS}')
    union
    select 'urls', host || path from located where host <> '' and ('0x' || substr(md5(host || path), 1, 8))::bigint % 16 = 0
  )
), entries as (
  select list, pattern, 1 as active, {PERIOD_START} + n % {PERIOD} as effective from patterns
  union all
  select list, pattern, 0, {PERIOD_START} + n % {PERIOD} + 5 * 86400 from patterns where n % 3 = 0
  union all
  select list, pattern, 1, {PERIOD_START} + n % {PERIOD} + 8 * 86400 from patterns where n % 6 = 0
), spans as (
  select * from (
    select list, pattern, active, effective as valid_from, lead(effective) over (partition by list, pattern order by effective) as valid_to from entries
  ) where active = 1
), matched as (
  select l.page_id, l.url, l.fetched, s.list, s.pattern, s.valid_from
  from located l join spans s
    on (l.host = s.pattern or ends_with(l.host, '.' || s.pattern) or l.host || l.path = s.pattern or starts_with(l.host || l.path, s.pattern || '/'))
   and s.valid_from <= l.fetched and (s.valid_to is null or l.fetched < s.valid_to)
), ranked as (
  select *, count(*) over (partition by page_id, url) as active_entries,
    row_number() over (partition by page_id, url order by length(pattern) desc, list, pattern, valid_from) as place
  from matched
)
select l.page_id, l.url, l.fetched, coalesce(r.active_entries, 0) as active_entries, r.list, r.pattern,
  r.valid_from as listed_since, r.page_id is not null as blocked
from located l left join ranked r on l.page_id = r.page_id and l.url = r.url and r.place = 1
"""


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards, counts at most one apart."""
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        (utf8_bytes(F.col("text")) + 8).alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text_crc32"),
    )
    return shard_rows(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned outside fold 2 of 4."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_fold(F.col("doc_id"), 4) == 2
    return identify(docs, docs.filter(~held_out), keep=(held_out.alias("held_out"),))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and likenesses."""
    return fingerprint_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents by piece_bpe_32k.model."""
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))


#: The conversation that op7 adds: its texts are full of control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def conversation_events(conversations: DataFrame) -> DataFrame:
    """An event log that leads to the rows of the table, by turn.

    Each row is opened, gets a first draft (its text backwards), is regenerated, streamed in two
    deltas, edited to its first half alone, and completed by a last delta.
    """
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    head, tail = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    turn = F.coalesce("turn", F.lit(-(1 << 40)))
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    numbered = conversations.select("conv_id", "turn", "role", "text", nth.alias("n"))
    message = F.concat_ws("/", turn, F.lpad(F.col("n").cast("string"), 12, "0"))
    steps = [("open", F.lit("")), ("delta", F.reverse(text)), ("regenerate", F.lit("")), ("delta", head), ("delta", F.lit("...")), ("edit", head), ("delta", tail)]
    log = F.array(*[F.struct((turn * 8 + i).alias("seq"), F.lit(event).alias("event"), words.alias("text")) for i, (event, words) in enumerate(steps)])
    return numbered.select("conv_id", message.alias("message"), F.coalesce("role", F.lit("")).alias("role"), F.explode(log).alias("e")).select(
        "conv_id", "e.seq", "message", "e.event", "role", "e.text"
    )


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, as read back from the rendered chat format."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], rows.schema)
    return conversation_digests(reconstruct(conversation_events(rows.unionByName(extra))))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents over 4-word shingles and their groups at 4 differing bits."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    groups = simhash_groups(docs, words_in_shingle=4, radius=4, seeds=(42,))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp_0")), 16, "0").alias("fingerprint"), "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of all documents, learned outside fold 0 of 5."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = id_fold(F.col("doc_id"), 5) == 0
    scored = score_toxicity(docs, docs.filter(~held_out), labels.filter(~held_out))
    return scored.select(
        "doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted")
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 5, 2, 1 of their sources, 150 % of all words, no source above 200 %."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select(
        "doc_id", "source",
        F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_passes")).alias("taken"),
    )


OP10_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 9))::bigint as h
  from documents
), sources as (
  select source, sum(size)::bigint as source_size from sized group by source
), weighed as (
  select *, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::bigint as weight from sources
), running as (
  select *, source_size * 1.0::double / weight as ratio,
    coalesce(sum(source_size) over (order by source_size * 1.0::double / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) * 2 as stopped,
    sum(weight) over (order by source_size * 1.0::double / weight, source nulls last rows between current row and unbounded following) as open,
    sum(source_size) over () as everything
  from weighed
), fitted as (
  select *, everything * 3 - stopped * 2 as remaining,
    (everything * 3 - stopped * 2)::double * weight <= source_size::double * open * 4 as fits
  from running
), level as (
  select remaining, open from fitted where fits order by ratio, remaining, open limit 1
), targets as (
  select f.source, f.source_size,
    case when f.fits then l.remaining::double * f.weight / (l.open * 2)::double else (f.source_size * 2)::double end as target
  from fitted f left join level l on true
), budgets as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as passes from targets
), rests as (
  select *, target - passes * source_size as rest from budgets
), summed as (
  select s.*, r.source_size, r.target, r.passes, r.rest,
    sum(s.size) over (partition by s.source order by s.h) as through
  from sized s join rests r on s.source is not distinct from r.source
), grouped as (
  select *, sum(size) over (partition by source, h) as tied from summed
), edges as (
  select *, min(case when through > rest then h end) over (partition by source) as edge from grouped
)
select doc_id, source, size, source_size, target,
  size * (passes + case
    when edge is null then case when rest > 0 then 1 else 0 end
    when h < edge then 1
    when h = edge and (through - rest) < (rest - (through - tied)) then 1
    else 0 end) as taken
from edges
"""


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Merkle manifest of all documents, one tree a language; some leaves are tampered with and checked."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")

    def leaf(n_chars: Column) -> Column:
        return hashed(encoded(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")))

    # null ids, and null counts, are not tampered with
    touched = (F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")), F.lit(7)) == 0) & F.col("n_chars").isNotNull()
    tampered = F.when(touched, leaf(F.col("n_chars") + 1)).alias("tampered")
    proofs = build_manifest(docs, F.col("lang"), [F.col("doc_id")], leaf(F.col("n_chars")), [F.col("doc_id"), tampered])
    root = folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root")
    told = proofs.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), root)
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The CRC-32 of a decimal number's text, in DuckDB.
_CRC32 = (
    "xor(list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint), "
    "lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x % 2 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295::bigint)"
)


def _field(value: str) -> str:
    return f"case when {value} is null then '-' else strlen({value}::varchar) || ':' || {value} end"


OP11_SQL = f"""
with recursive leaves as materialized (
  select doc_id, lang, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n, leaf, tampered from (
    select doc_id, lang, sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', 'text')))}) as leaf,
      case when {_CRC32} % 7 = 0 and n_chars is not null then sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', '(n_chars + 1)', 'text')))}) end as tampered
    from documents)
), lower_ as (
  select lang, 0 as l, i, leaf as h, n from leaves
  union all select lang, l + 1, i // 2, sha256(string_agg(h, '' order by i)), (n + 1) // 2 from lower_ where n > 1 group by lang, l, i // 2, n
), trees as materialized (
  select lang, h, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as n from lower_ where n = 1
), upper_ as (
  select 0 as l, i, h, n from trees
  union all select l + 1, i // 2, sha256(string_agg(h, '' order by i)), (n + 1) // 2 from upper_ where n > 1 group by l, i // 2, n
), low as materialized (select * from lower_ where n > 1), up as materialized (select * from upper_ where n > 1),
steps as (
  select f.lang, f.i, x.l as place, s.h, s.i < (f.i >> x.l) as before_ from leaves f join (select distinct lang, l from low) x on x.lang is not distinct from f.lang
    left join low s on s.lang is not distinct from f.lang and s.l = x.l and s.i = xor(f.i >> x.l, 1::bigint)
  union all
  select f.lang, f.i, 1000 + x.l, s.h, s.i < (t.i >> x.l) from leaves f join trees t on t.lang is not distinct from f.lang cross join (select distinct l from up) x
    left join up s on s.l = x.l and s.i = xor(t.i >> x.l, 1::bigint)
), ways as (
  select lang, i, list(case when h is null then '' when before_ then '<' || h else '>' || h end order by place) as way from steps group by lang, i
), told as (
  select f.doc_id, f.leaf, t.h as subroot, (select h from upper_ where n = 1) as root, coalesce(way, []) as way, coalesce(tampered, leaf) as seen
  from leaves f join trees t on t.lang is not distinct from f.lang left join ways w on w.lang is not distinct from f.lang and w.i = f.i
), found as (
  select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(way, lambda s: substr(s, 2)), '')) as proof_sha256,
    list_reduce([seen] || way, lambda h, s: case when s = '' then sha256(h) when s[1] = '<' then sha256(substr(s, 2) || h) else sha256(h || substr(s, 2)) end) as folded_root
  from told
)
select *, folded_root = root as verified from found
"""


def looped(text: Column, doc_id: Column) -> Column:
    """The text of op12: for one id in ten by its CRC-32, words from a place on repeat with a period; else the text itself.

    Null ids keep their text.
    """
    h = F.crc32(F.encode(doc_id.cast("string"), "utf-8"))
    g = F.floor(h / 10)

    def looping(words: Column) -> Column:
        n = F.size(words)
        first = F.pmod(g, n)
        period = F.floor((n - first) / (F.pmod(g, F.lit(8)) + 3)) + 1
        place = lambda i: F.when(i < first, i).otherwise(first + F.pmod(i - first, period))
        return F.array_join(F.transform(words, lambda _, i: F.get(words, place(i).cast("int"))), " ")

    # bound to a name of their own, so that words are split once
    made = F.element_at(F.transform(F.array(F.regexp_extract_all(text, F.lit(f"({WORD})"))), looping), 1)
    return F.when((F.pmod(h, F.lit(10)) == 0) & F.regexp_like(text, F.lit(WORD)), made).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in all documents, a tenth of them made to loop, and the texts without them."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", looped(F.col("text"), F.col("doc_id")).alias("text"))
    found = find_runs(docs)
    # of the runs in order of start and period the first with the greatest length a period
    better = lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), better)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed")
    return told.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.col("n_runs") > 0, F.concat("lines", F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are kept: those that pass the base and are likelier good than not by the rules' votes."""
    featured = cut(with_features(read_table(spark, sf_dir, "documents").select("doc_id", "text")))
    judged = judge_quality(featured, fit_quality(featured))
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("quality") >= 0.5)).alias("kept"), "quality",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name; each takes a session and the folder of the tables."""
    return {
        "op1_url_filter": op1_url_filter,
        "op2_shards": op2_shards,
        "op3_language_id": op3_language_id,
        "op4_decontamination": op4_decontamination,
        "op5_fingerprints": op5_fingerprints,
        "op6_token_counts": op6_token_counts,
        "op7_chat_format": op7_chat_format,
        "op8_simhash": op8_simhash,
        "op9_toxicity": op9_toxicity,
        "op10_mixing": op10_mixing,
        "op11_manifest": op11_manifest,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_quality": op13_quality,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {"op1_url_filter": OP1_SQL, "op10_mixing": OP10_SQL, "op11_manifest": OP11_SQL}
