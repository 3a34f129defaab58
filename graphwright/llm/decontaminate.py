"""Benchmark decontamination by template canonicalisation.

Texts become template tokens: numbers (in digits or words), units and names turn into typed
placeholders, all other words are lower-cased without the punctuation around them. A number with its
unit attached is two tokens, a run of number words is one, and so is a run of capitalised words, as
long as no punctuation parts them. Digits within a word (5x, x^2) are a placeholder in that word, and
a sign of arithmetic that stands alone is a word. A capitalised word is a name wherever it stands; that of a
sentence's first word is unknown, but item and document are read alike. Windows of five tokens are
hashed, and the windows of documents are joined with those of benchmark items on the hash.

Names are told by capitals, so a text is read in two ways: with names as placeholders, and with
names as words, where each window is hashed with placeholders for numbers and units, and with none.
So copies in other capitals are found, and items of hardly anything but numbers or names. Items of
fewer than five tokens have one window of their own width, and documents are searched at the widths
of the items.

Whether a document holds an item is decided for each pair of them, and each way of reading, by all
the windows that match. Windows that are no further apart than the item is long make a region. In a
region each slot value of the item stands for one value in the document, and two names never stand
for one; the alignments with most windows come first, and windows that contradict them don't count.
An item's window is held if all its tokens are held, and a leak is a region that holds enough of all
the item's windows. Tokens in windows that count are held. So are tokens up to AROUND further out in
the same alignment, which each window carries, where windows alone hold too little: those that are alike; placeholders with consistent
values beside a word that is alike; and words that differ, as names in lower case do, if those on both
sides are held, one word stands for one throughout, and no more than RENAMED of the item's tokens are
of this kind.

Documents are filtered on the way to the join by a bitmap of the items' window hashes. The bitmap
has a fixed size, whatever the number of items, so it may be sent to every task; what passes it by
chance is dropped by the join.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.llm.words import WordTable, slices, unused
from graphwright.plans.checkpoints import cut

WINDOW = 5
#: Share of an item's windows that a document must hold, with consistent slots.
THRESHOLD = 0.8
#: A window with placeholders needs so many other tokens; without placeholders it needs none.
LITERALS = 2
#: Tokens on each side of a window that are compared once the window has matched.
AROUND = WINDOW
#: Share of an item's tokens that may be words replaced by other words.
RENAMED = 0.2
#: Bits of the bitmap, as a power of two: 2 MB.
FILTER_BITS = 24
#: Salts of the join, against windows that very many documents share.
SALTS = 16
#: Rows that name leaking texts are broadcast up to this number, about 8 MB.
BROADCAST_ROWS = 500_000
#: Words that a task remembers at one time.
REMEMBERED = 1 << 17
#: Words of texts that are worked on at once, about; a longer text is worked on alone.
BLOCK = 1 << 14
#: Ways of reading: names as placeholders, names as words.
NAMED, PLAIN = 0, 1

# Words that count as units after a number.
UNITS = frozenset(
    """% percent cent cents dollar dollars euro euros pound pounds usd eur gbp
    mm cm m km metre metres meter meters inch inches foot feet ft yard yards mile miles
    mg g kg gram grams kilogram kilograms ton tons tonne tonnes lb lbs ounce ounces oz
    ml l litre litres liter liters gallon gallons
    ms s sec second seconds minute minutes min hour hours h day days week weeks month months year years
    hz khz mhz ghz w kw mw v volt volts watt watts j joule joules n newton newtons pa bar
    degree degrees celsius fahrenheit km/h mph kb mb gb tb""".split()
)

# English number words.
SMALL_NUMBERS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen
    fifteen sixteen seventeen eighteen nineteen""".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBER_WORDS = dict(zip(SMALL_NUMBERS, range(20), strict=True)) | {t: 10 * i for i, t in enumerate(TENS, 2)} | {"hundred": 100, "thousand": 1000, "million": 10**6, "billion": 10**9}

# Signs of arithmetic that are words when they stand alone; a dash is not.
SIGNS = frozenset("+ * / = ^ < > × ÷".split())

_EDGE = re.compile(r"^[^\w%$€£]+|[^\w%]+$")
_NUMBER = re.compile(r"([$€£+\-]?\d[\d.,:/\-]*)([^\d.,:/\-]*)")
_DIGITS = re.compile(r"\d+(?:[.,]\d+)*")
_ENDS = (".", "!", "?", ":")
_NUM, _NAME, _UNIT = (np.uint64(xxhash.xxh64_intdigest(t)) for t in ("<number>", "<name>", "<unit>"))

NUMBER, UNIT_WORD, CAPITAL, ENDS_SENTENCE, EMPTY, CLOSED, SPELLED, ATTACHED, GLUED = (1 << i for i in range(9))


def composed(words: list[str]) -> str:
    """The digits of a run of number words."""
    total, part = 0, 0
    for word in words:
        value = NUMBER_WORDS[word]
        if value < 100:
            part += value
        elif value == 100:
            part = (part or 1) * value
        else:
            total, part = total + (part or 1) * value, 0
    return str(total + part)


def spelled(low: str) -> list[str]:
    """The number words that a word is made of, if it is made of nothing else."""
    if "-" not in low:
        return [low] if low in NUMBER_WORDS else []
    parts = low.split("-")
    return parts if all(p in NUMBER_WORDS for p in parts) else []


def measure(bare: str) -> tuple[str, str]:
    """(number, attached unit) of a word; the unit may be missing, and both are if it is no number."""
    if found := _NUMBER.fullmatch(bare):
        number, unit = found[1].rstrip(".,:/-"), found[2].lower()
        if not unit or unit in UNITS:
            return number, unit
    return "", ""


def word_kind(word: str) -> tuple[int, int, int]:
    """(hash of the bare lower-case word, flags, other hash) of one word with its punctuation.

    The other hash is that of an attached unit, or of a word with its digits left out.
    """
    bare = word if word.isalpha() else _EDGE.sub("", word)
    flags = 0
    if bare is not word:
        tail = word.rstrip("\"')»”")
        flags = (ENDS_SENTENCE if tail.endswith(_ENDS) else 0) | (CLOSED if not word[-1].isalnum() else 0)
        if not bare:
            return (xxhash.xxh64_intdigest(word), flags, 0) if word in SIGNS else (0, flags | EMPTY, 0)
    low, unit = bare.lower(), ""
    if bare[0].isdecimal() or bare[0] in "$€£+-":
        number, unit = measure(bare)
        if number:
            low = number
            flags |= NUMBER | (ATTACHED if unit else 0)
    elif parts := spelled(low):
        low = composed(parts)
        flags |= NUMBER | SPELLED
    elif low in UNITS:
        flags |= UNIT_WORD
    if bare[0].isupper():
        flags |= CAPITAL
    if not flags & NUMBER and (masked := without_digits(low)) != low:
        return xxhash.xxh64_intdigest(low), flags | GLUED, xxhash.xxh64_intdigest(masked)
    return xxhash.xxh64_intdigest(low), flags, xxhash.xxh64_intdigest(unit) if unit else 0


def without_digits(low: str) -> str:
    """A word with a placeholder for each number in it."""
    return _DIGITS.sub("<number>", low)


def word_kinds(words: list[str]) -> list[np.ndarray]:
    """(hashes, flags, other hashes) of words; plain words, which most are, take a short way."""
    lows = list(map(str.lower, words))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, lows), np.uint64, len(words))
    flags = np.fromiter((CAPITAL if w[0].isupper() else 0 for w in words), np.uint16, len(words))
    units = np.zeros(len(words), np.uint64)
    for i, (word, low) in enumerate(zip(words, lows, strict=True)):
        if not word.isalpha() or low in UNITS or low in NUMBER_WORDS:
            hashes[i], flags[i], units[i] = word_kind(word)
    return [hashes, flags, units]


class Reading:
    """Texts one after another as tokens, read in one way.

    text: each token's text; first, last: its words; hashes; masked: the same without digits within words;
    number, unit, name, glued: what it stands for.
    """

    def __init__(self, text: np.ndarray, first: np.ndarray, last: np.ndarray, hashes: np.ndarray, masked: np.ndarray, number: np.ndarray, unit: np.ndarray, name: np.ndarray, glued: np.ndarray) -> None:
        self.text, self.first, self.last, self.hashes, self.masked, self.number, self.unit, self.name, self.glued = text, first, last, hashes, masked, number, unit, name, glued

    def merged(self, joins: np.ndarray) -> Reading:
        """Each token that joins made one with the token before it."""
        if not joins.any():
            return self
        starts = np.flatnonzero(~joins)
        ends = np.append(starts[1:], len(joins)) - 1
        return Reading(self.text[starts], self.first[starts], self.last[ends], np.add.reduceat(self.hashes, starts), np.add.reduceat(self.masked, starts), self.number[starts], self.unit[starts], self.name[starts], self.glued[starts])


class Templates:
    """Turns texts into hashed template windows; remembers a bounded number of words."""

    def __init__(self) -> None:
        self.table = WordTable(REMEMBERED, word_kinds)

    def read(self, words: list[str], text: np.ndarray) -> tuple[Reading, Reading]:
        """(names as placeholders, names as words) of the words of texts; text is the number of each word's text."""
        parts = []
        for at in range(0, len(words), REMEMBERED // 2):
            columns, rows = self.table.rows(words[at : at + REMEMBERED // 2])
            parts.append([c[rows] for c in columns])
        hashes, flags, units = (np.concatenate(p) for p in zip(*parts, strict=True))
        ends = np.concatenate([[0], np.cumsum((flags & ENDS_SENTENCE) > 0)])
        word = np.flatnonzero((flags & EMPTY) == 0)
        # a number with its unit is two tokens
        word = np.repeat(word, 1 + ((flags[word] & ATTACHED) > 0))
        n = len(word)
        new = np.ones(n, bool)
        new[1:] = text[word[1:]] != text[word[:-1]]
        second = np.zeros(n, bool)
        second[1:] = word[1:] == word[:-1]
        before = np.concatenate([[0], word[:-1]])  # the word of the token before
        kind = flags[word]
        # a sentence begins where one of the words since the last token, which may be punctuation, has ended one
        opens = new | (ends[word] > ends[before])
        number = ((kind & NUMBER) > 0) & ~second
        earlier = np.zeros(n, bool)
        earlier[1:] = number[:-1]
        unit = second | ((kind & UNIT_WORD) > 0) & earlier & ~new & ~opens
        name = ((kind & CAPITAL) > 0) & ~number & ~unit
        glued = (kind & GLUED) > 0
        own = np.where(second, units[word], hashes[word])
        words_read = Reading(text[word], word, word, own, np.where(glued, units[word], own), number, unit, name, glued)
        # runs go on if no punctuation stands between
        goes_on = ~opens & ~second & ((flags[before] & CLOSED) == 0) & (word - before == 1)
        written = (kind & SPELLED) > 0
        follows = np.zeros(n, bool)
        follows[1:] = written[:-1]
        run = goes_on & written & follows
        plain = words_read.merged(run)
        goes_on = goes_on[~run]
        follows = np.zeros(len(goes_on), bool)
        follows[1:] = plain.name[:-1]
        return plain.merged(goes_on & plain.name & follows), plain

    def rows(self, texts: list[str | None], keep: np.ndarray | None, widths: tuple[int, ...]) -> Iterator[tuple[int, int, int, int, int, int, list[str], list[str]]]:
        """(text, way of reading, windows, width, position, hash, slot values, tokens around) of texts' windows, those in the bitmap only if one is given.

        Without widths the texts are items: their windows have WINDOW tokens, or all of a shorter text.
        Hashes of one window that are equal are listed once. The tokens around are those of the window and
        AROUND more on each side, empty beyond the text.
        """
        split = [(t or "").split() for t in texts]
        words = [w for own in split for w in own]
        if not words:
            return
        text = np.repeat(np.arange(len(split)), [len(own) for own in split])
        for way, reading in zip((NAMED, PLAIN), self.read(words, text), strict=True):
            if not len(reading.text):
                continue
            counts = np.bincount(reading.text, minlength=len(split))
            starts = np.cumsum(counts) - counts
            token = cache(partial(self._token, words, reading, way))
            for width in widths or tuple(np.unique(np.minimum(counts[counts > 0], WINDOW)).tolist()):
                if width > len(reading.text):
                    continue
                fits = reading.text[: len(reading.text) - width + 1] == reading.text[width - 1 :]
                if not widths:
                    fits &= np.minimum(counts, WINDOW)[reading.text[: len(fits)]] == width
                for at, found, slot in self._windows(reading, way, width, fits, keep):
                    for p, h in zip(at.tolist(), found.tolist(), strict=True):
                        values = [v for i in range(p, p + width) if slot[i] for v in [self._value(words, reading, i)]]
                        mine = int(reading.text[p])
                        start, end = int(starts[mine]), int(starts[mine] + counts[mine])
                        around = [token(i) if start <= i < end else "" for i in range(p - AROUND, p + width + AROUND)]
                        yield mine, way, end - start - width + 1, width, p - start, h, values, around

    @staticmethod
    def _windows(reading: Reading, way: int, width: int, fits: np.ndarray, keep: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(positions, hashes, which tokens are slots) for each kind of placeholders of one way of reading."""
        measured = reading.number | reading.unit
        token = np.where(reading.number, _NUM, np.where(reading.unit, _UNIT, reading.masked))
        if way == NAMED:
            kinds = [(np.where(reading.name, _NAME, token), measured | reading.name, measured | reading.name | reading.glued)]
        else:
            # a number that stays is a slot value too
            kinds = [(token, measured, measured | reading.glued), (reading.hashes, np.zeros(len(token), bool), reading.number | reading.glued)]
        earlier: list[np.ndarray] = []
        for tokens, blank, slot in kinds:
            rolled, usable = window_hashes(tokens, blank, width, 2 * width + way)
            usable &= fits
            for other in earlier:
                # equal hashes have the same placeholders, so both are usable or neither is
                usable &= rolled != other
            earlier.append(rolled)
            at = np.flatnonzero(usable if keep is None else usable & in_bitmap(keep, rolled))
            yield at, rolled[at].view(np.int64), slot

    @staticmethod
    def _value(words: list[str], reading: Reading, i: int) -> str:
        """The slot value of a token: digits, a unit, or a name in lower case; its type comes first."""
        bare = [_EDGE.sub("", w).lower() for w in words[reading.first[i] : reading.last[i] + 1]]
        bare = [w for w in bare if w]
        if reading.number[i]:
            parts = [p for w in bare for p in spelled(w)]
            return f"n{composed(parts)}" if parts else f"n{measure(bare[0])[0]}"
        if reading.unit[i]:
            return f"u{measure(bare[0])[1] or bare[0]}"
        if reading.name[i]:
            return f"m{' '.join(bare)}"
        return f"g{bare[0]}"

    @classmethod
    def _token(cls, words: list[str], reading: Reading, way: int, i: int) -> str:
        """A token as it is compared around a window: its slot value, or w (W with a capital) and the word."""
        if reading.number[i] or reading.unit[i] or reading.glued[i] or way == NAMED and reading.name[i]:
            return cls._value(words, reading, i)
        word = words[reading.first[i]]
        word = _EDGE.sub("", word) or word
        return ("W" if word[0].isupper() else "w") + word.lower()


def window_hashes(token: np.ndarray, blank: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the window at each token, whether it has no placeholder or enough other tokens); short windows have none."""
    count = len(token) - width + 1
    rolled, literal = np.full(count, seed, np.uint64), np.zeros(count, np.int64)
    for j in range(width):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + token[j : count + j]
        literal += ~blank[j : count + j]
    rolled ^= rolled >> np.uint64(29)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    rolled ^= rolled >> np.uint64(32)
    return rolled, literal >= (LITERALS if width >= WINDOW else width)


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash's bit is set."""
    bit = hashes >> np.uint64(64 - FILTER_BITS)
    return (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


def in_blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Stretches of a list of texts of about BLOCK words, of six bytes each."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= 6 * BLOCK:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def template_windows(rows: DataFrame, bitmap: np.ndarray | None, widths: tuple[int, ...] = ()) -> DataFrame:
    """(id, content, text) -> (id, content, way, windows, width, pos, hash, slots, around): one row for each hash of each window.

    windows is the number of all windows of an item, width their tokens; see Templates.rows.
    """
    names = ["id", "content", "way", "windows", "width", "pos", "hash", "slots", "around"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in slices(batches):
            ids, contents, texts = (c.to_pylist() for c in batch.columns)
            for start, end in in_blocks(texts):
                found = [(ids[start + i], contents[start + i], *rest) for i, *rest in templates.rows(texts[start:end], bitmap, widths)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)

    return rows.mapInArrow(cut_up, "id long, content long, way int, windows long, width int, pos long, hash long, slots array<string>, around array<string>")


def window_bitmap(items: DataFrame) -> np.ndarray:
    """The bitmap of all hashes of items(hash); at most 2 ** FILTER_BITS / 64 rows reach the driver."""
    bit = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    mask = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - FILTER_BITS}) & 63L as int))")
    cells = items.groupBy(F.shiftright(bit, 6).alias("cell")).agg(F.bit_or(mask).alias("mask")).toArrow()
    out = np.zeros((1 << FILTER_BITS) // 64, np.uint64)
    out[cells.column("cell").to_numpy().astype(np.int64)] = cells.column("mask").to_numpy().astype(np.int64).view(np.uint64)
    return out.view(np.uint8)


#: Position in the item and in the document, slot values of both; then the tokens around of both, if they are known.
Match = tuple[int, int, list[str], list[str]] | tuple[int, int, list[str], list[str], list[str], list[str]]


def judged(matches: list[Match], windows: int, width: int, threshold: float = THRESHOLD) -> tuple[int, int, int, bool]:
    """(windows held, windows that match, windows that count, whether they are verbatim) of the best region."""
    matches = sorted(matches, key=lambda m: (m[1], m[0]))
    best = (0, 0, 0, False)
    start = 0
    for i in range(1, len(matches) + 1):
        if i < len(matches) and matches[i][1] - matches[i - 1][1] <= windows + width:
            continue
        region, start = matches[start:i], i
        best = max(best, _judged_region(region, windows, width, threshold))
    return best


def _judged_region(region: list[Match], windows: int, width: int, threshold: float) -> tuple[int, int, int, bool]:
    often = Counter(m[1] - m[0] for m in region)
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    held = np.zeros(windows + width - 1, bool)
    counted: set[int] = set()
    verbatim = True
    # (item's position, alignment) -> the tokens there, in order of the windows that count
    beside: dict[tuple[int, int], tuple[str, str]] = {}
    for pos, at, mine, theirs, *around in sorted(region, key=lambda m: (-often[m[1] - m[0]], m[1] - m[0], m[0])):
        if pos in counted:
            continue
        new, new_back = dict(there), dict(back)
        if any(new.setdefault(a, b) != b or a[0] == "m" and new_back.setdefault(b, a) != a for a, b in zip(mine, theirs, strict=True)):
            continue
        there, back = new, new_back
        counted.add(pos)
        held[pos : pos + width] = True
        verbatim &= mine == theirs
        if around:
            beside |= {(i, at - pos): (a, b) for i, (a, b) in enumerate(zip(*around, strict=True), pos - AROUND) if a and b}
    covered = np.convolve(held, np.ones(width, np.int64), "valid") == width
    # what windows settle alone needs no look beside them
    if beside and covered.sum() < threshold * windows:
        verbatim &= _hold_beside(beside, held, there, back)
        covered = np.convolve(held, np.ones(width, np.int64), "valid") == width
    return int(covered.sum()), len({m[0] for m in region}), len(counted), verbatim


def _hold_beside(beside: dict[tuple[int, int], tuple[str, str]], held: np.ndarray, there: dict[str, str], back: dict[str, str]) -> bool:
    """Marks tokens beside windows that count as held, if they are alike, have consistent values or are other words; whether all are alike."""
    alike = True
    differing: dict[int, tuple[str, str]] = {}
    literal = {i for (i, _), (a, b) in beside.items() if a[0] in "wW" and a[1:] == b[1:]}
    for (i, _), (a, b) in beside.items():
        if held[i]:
            continue
        if a[0] in "wW" and b[0] in "wWm":
            if a[1:] == b[1:]:
                held[i] = True
            # a word without a capital may be a name, and one with a capital is no other word without
            elif a[0] == "w" or b[0] == "W":
                differing.setdefault(i, (a, b))
        elif a[0] == b[0] and (a == b or {i - 1, i + 1} & literal) and (a[0] != "g" or without_digits(a) == without_digits(b)):
            # a value that differs stands beside a word that doesn't
            if there.get(a, b) == b and (a[0] != "m" or back.get(b, a) == a):
                there[a], back[b], held[i] = b, a, True
                alike &= a == b
    # a word that differs stands between words that don't
    ends = np.concatenate([[True], held, [True]])
    renamed = {i: ab for i, ab in differing.items() if not held[i] and ends[i] and ends[i + 2]}
    pairs = {(a[1:], b[1:]) for a, b in renamed.values()}
    kept = {a[1:] for (i, _), (a, b) in beside.items() if held[i] and i in literal and a[1:] == b[1:]}
    one_to_one = len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) and not any(kept & {a, b} for a, b in pairs)
    if not renamed or not one_to_one or len(renamed) > RENAMED * len(held):
        return alike
    held[list(renamed)] = True
    return False


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(doc_id, content, item_id, item_windows, shared_windows, consistent_windows, coverage, kind): each leak found.

    coverage is the share of all the item's windows that the document holds in one region with
    consistent slots, and is threshold or more; kind is verbatim if all slots are the item's own,
    else reparameterised. Texts are worked on whole. Documents of one id and different texts, told
    apart by content, a hash of the text, are judged each by itself, and so are items of one id;
    equal rows count once. Ids may be null. Items without a word leak nowhere; null and empty
    documents hold nothing; further columns are ignored. Either table may be empty.
    """
    benchmark = items.select(F.col(item_key).cast("long").alias("id"), content_hash(item_text).alias("content"), F.col(item_text).alias("text")).distinct()
    known = cut(template_windows(benchmark, None))
    bitmap = window_bitmap(known)
    widths = tuple(sorted(r["width"] for r in known.select("width").distinct().collect())) or (WINDOW,)
    corpus = docs.select(F.col(key).cast("long").alias("id"), content_hash(text).alias("content"), F.col(text).alias("text"))
    found = template_windows(corpus, bitmap, widths).select("id", "content", "pos", "hash", "slots", "around").withColumn("salt", F.pmod(F.xxhash64("id", "content"), F.lit(SALTS)))
    salted = known.select(
        F.col("id").alias("item_id"), F.col("content").alias("item_content"), "way", "windows", "width", F.col("pos").alias("item_pos"), F.col("hash").alias("h"), F.col("slots").alias("item_slots"), F.col("around").alias("item_around"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("s"),
    )
    pairs = found.join(salted, (F.col("hash") == F.col("h")) & (F.col("salt") == F.col("s")))
    one = ["id", "content", "item_id", "item_content", "way", "windows", "width"]
    # a window that is held has its tokens in or around windows that match
    few = F.size(F.array_distinct(F.col("matches.item_pos"))) * (F.col("width") + 2 * AROUND) >= F.lit(threshold) * F.col("windows")
    grouped = pairs.groupBy(*one).agg(F.collect_set(F.struct("item_pos", "pos", "item_slots", "slots", "item_around", "around")).alias("matches")).filter(few)
    names = ["shared", "counted", "held", "verbatim"]

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for windows, width, matches in zip(*(batch.column(c).to_pylist() for c in ("windows", "width", "matches")), strict=True):
                held, shared, counted, verbatim = judged([tuple(m.values()) for m in matches], windows, width, threshold)
                out.append((shared, counted, held, verbatim))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)] if out else [pa.array([], pa.int64())] * 3 + [pa.array([], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in one), *columns], names=[*one, *names])

    schema = "id long, content long, item_id long, item_content long, way int, windows long, width int, shared long, counted long, held long, verbatim boolean"
    results = grouped.mapInArrow(decided, schema).withColumn("coverage", F.col("held") / F.col("windows")).filter(F.col("coverage") >= threshold)
    # of the two ways of reading the one with more
    best = F.max(F.struct("coverage", "verbatim", "held", "windows", "shared", "counted")).alias("best")
    return results.groupBy("id", "content", "item_id", "item_content").agg(best).select(
        F.col("id").alias("doc_id"), "content", "item_id",
        F.col("best.windows").alias("item_windows"), F.col("best.shared").alias("shared_windows"), F.col("best.held").alias("consistent_windows"), "best.coverage",
        F.when(F.col("best.verbatim"), "verbatim").otherwise("reparameterised").alias("kind"),
    )


def content_hash(text: str) -> Column:
    """64 bits that tell the texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def without_leaks(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """docs without the rows that hold a benchmark item, whatever their id; columns of any name are kept as they are."""
    leak, hashed = unused("leak_id", docs), unused("leak_content", docs)
    leaks = cut(find_leaks(docs, items, key=key, text=text, **options).select(F.col("doc_id").alias(leak), F.col("content").alias(hashed)).distinct())
    same = F.col(key).cast("long").eqNullSafe(F.col(leak)) & (content_hash(text) == F.col(hashed))
    return docs.join(F.broadcast(leaks) if leaks.count() <= BROADCAST_ROWS else leaks, same, "left_anti")
