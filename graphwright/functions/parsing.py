"""More text expressions: keys, pieces, page numbers, references, digests, checks. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Longest segment, longest header, and patterns of sentence ends, generic headers and aliases.
SEGMENT_CHARS = 700
HEADER_CHARS = 40
SENTENCE_END = r"(?<=[.!?;:])\s+"
GENERIC_HEADER = r"(?i)^col[0-9]+$"
DECLARED_ALIAS = r"(?i)also called|aka|also known"
LIST_MARK = r"\n|[•●▪]|(?:^|\s)[0-9]+[.)]\s+"
NUMBER_MATRIX = r"\b[0-9]+(?:\s*[*;,|]\s*[0-9]+){2,}\b"
NUMBERED_ENTRY = r"^\s*([0-9]+)[.)]\s+(.+)"
CELL_LABEL = r"^(?:TABLE COLUMNS: )?[^|:]{1,40}?(?: \(same as row above\))?: "
OPAQUE_ID = r"^[a-z][a-z0-9_]*_[A-Za-z0-9_-]{10,}$"
UTC_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?Z$"

# Texts that stand for a missing value.
PLACEHOLDERS = ("-", "n/a", "na", "none", "non disponibile", "not available", "placeholder", "tbd", "todo", "unknown")


def one_space(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def text_key(text: Column) -> Column:
    """Lower case, everything but letters, digits and underscores as single spaces."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def scoring_key(text: Column) -> Column:
    """Lower case with single spaces; symbols, signs and leading zeros stay."""
    return F.lower(one_space(text))


def split_block(text: Column, longest: int = SEGMENT_CHARS) -> Column:
    """Pieces of a block: all of it if it is short, else sentences packed in order up to the length; a longer sentence is a piece."""
    compact = one_space(text)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(state: Column, sentence: Column) -> Column:
        full = (state["now"] != "") & (F.length(state["now"]) + F.length(sentence) + 1 > longest)
        joined = F.btrim(F.concat_ws(" ", state["now"], sentence))
        return F.struct(
            F.when(full, F.array_append(state["done"], state["now"])).otherwise(state["done"]).alias("done"),
            F.when(full, sentence).otherwise(joined).alias("now"),
        )

    packed = F.aggregate(F.split(compact, SENTENCE_END), start, step, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.array_append(s["done"], s["now"])))
    return F.when(F.length(compact) <= longest, F.array(compact)).otherwise(packed)


def page_numbers(text: Column) -> Column:
    """Pages that a list like 11, 12-14 names, in order, repeats included; dashes of any kind make ranges."""
    parts = F.split(F.regexp_replace(F.regexp_replace(text, "[–—]", "-"), r"\s+", ""), ",")
    ends = F.transform(F.filter(parts, lambda p: p.rlike("^[0-9]+(-[0-9]+)?$")), lambda p: F.split(p, "-"))
    return F.flatten(F.transform(ends, lambda e: F.sequence(F.get(e, F.lit(0)).cast("int"), F.greatest(F.get(e, F.lit(0)).cast("int"), F.element_at(e, -1).cast("int")))))


def useful_headers(headers: Column) -> Column:
    """headers, or none if all are generic or blank, or one is too long to be a name."""
    nothing = F.forall(headers, lambda h: h.rlike(GENERIC_HEADER) | (F.btrim(h) == "")) | F.exists(headers, lambda h: F.length(F.btrim(h)) > HEADER_CHARS)
    return F.when(nothing, F.array().cast("array<string>")).otherwise(F.transform(headers, lambda h: F.btrim(h)))


def list_pieces(text: Column) -> Column:
    """Pieces of a list: by lines, bullets and numbering."""
    return F.filter(F.transform(F.split(text, LIST_MARK), lambda p: F.btrim(p)), lambda p: p != "")


def matrix_numbers(text: Column) -> Column:
    """The numbers of each run of three or more that separators part."""
    runs = F.regexp_extract_all(text, F.lit(f"({NUMBER_MATRIX})"), 1)
    return F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit("([0-9]+)"), 1))


def plain_cells(text: Column) -> Column:
    """A rendered row without its column labels, one space per gap."""
    cells = F.transform(F.split(text, r"\s*\|\s*"), lambda c: one_space(F.regexp_replace(F.btrim(c), CELL_LABEL, "")))
    return F.array_join(F.filter(cells, lambda c: c != ""), " | ")


def cited_pages(segments: Column) -> Column:
    """Distinct pages of segment ids like p3.b7, sorted; others have none."""
    pages = F.transform(segments, lambda s: F.nullif(F.regexp_extract(s, r"^p([0-9]+)\.", 1), F.lit("")).cast("int"))
    return F.array_sort(F.array_distinct(F.array_compact(pages)))


def canonical_digest(**fields: Column) -> Column:
    """SHA-256 of a flat JSON object with sorted keys, without spaces, nulls written."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def is_opaque_id(value: Column) -> Column:
    """Whether a text is a prefixed id."""
    return F.coalesce(F.btrim(value).rlike(OPAQUE_ID), F.lit(False))


def is_utc_time(value: Column) -> Column:
    """Whether a text is an ISO time in UTC that ends in Z, and a real one."""
    text = F.btrim(value)
    return F.coalesce(text.rlike(UTC_TIME) & F.try_to_timestamp(text).isNotNull(), F.lit(False))


def attested(value: Column) -> Column:
    """The trimmed text, or null if it is missing or stands for a missing one."""
    text = F.btrim(value)
    return F.when((text != "") & ~F.lower(text).isin(*PLACEHOLDERS), text)


def percent_mark(x: Column, width: Column) -> Column:
    """A position in hundredths of a width, halves to even."""
    return F.bround(100 * x / width).cast("int")


def object_of(text: Column, schema: str) -> Column:
    """A JSON object in a text, with or without a fence or words around it; null if there is none that can be read."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    repaired = F.regexp_replace(F.regexp_replace(body, r",\s*([}\]])", "$1"), "[“”]", '"')
    return F.when(body != "", F.from_json(repaired, schema))


def rendered_cell(name: Column, value: Column, inherited: Column) -> Column:
    """header: value, with a note if the value is that of the row above."""
    return F.concat(name, F.when(inherited, " (same as row above)").otherwise(""), F.lit(": "), value)
