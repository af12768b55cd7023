"""Document fingerprints by Order MinHash, in DataFrame operations only.

A text's k-mers are runs of K tokens; a token is a word, or a piece of at most PIECE code
points of a longer one. Each k-mer carries the number of its earlier occurrences, so that a
repeated passage counts as often as it is there. For each of SLOTS hash functions the TUPLE
smallest of these numbered k-mers are taken, put back in text order and hashed together:
two texts agree in a slot if they share those k-mers *and* have them in the same order, which
an edit distance sees and a plain MinHash does not.

The hash functions are rotations of one: slot j begins at j / SLOTS of the hash circle, and
its smallest k-mers are the next ones on the circle. One sort of a text's k-mers so serves
all slots, whatever the text's length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 2
TUPLE = 2
SLOTS = 64
PIECE = 8
_TOKEN = rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"

#: A long holds a hash of 33 bits above a place of 30 bits (no text has 2^30 tokens).
_PLACE_BITS = 30
_PLACES = (1 << _PLACE_BITS) - 1
_HASHES = (1 << 33) - 1
_SLOT_SPAN = (1 << 33) // SLOTS
_IN_SLOT = (_SLOT_SPAN << _PLACE_BITS) - 1

#: Texts of one range of ids that are sorted together; no more than MAX_RANGES ranges.
RANGE_BYTES = 8 << 20
MAX_RANGES = 50_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _where(array: Column, holds: Callable[[Column, Column], Column]) -> Column:
    """Ascending places (from 0) of the elements for which ``holds(element, place)``."""
    return F.filter(F.transform(array, lambda x, i: F.when(holds(x, i), i)), lambda i: i.isNotNull())


def _pack(hashed: Column, place: Column) -> Column:
    return F.shiftleft(hashed.bitwiseAND(F.lit(_HASHES)), _PLACE_BITS).bitwiseOR(place.cast("long"))


def _hash_of(packed: Column) -> Column:
    return F.shiftright(packed, _PLACE_BITS)


def order_minhash(text: Column) -> Column:
    """The SLOTS numbers (0 to 65535) of a text; none for a text without words or null."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0))
    return _let(tokens, lambda held: _let(_kmers(held), lambda kmers: _let(_numbered(kmers), lambda ring: _tuples(kmers, ring))))


def _kmers(tokens: Column) -> Column:
    """Hash of each run of K tokens; a shorter text is one k-mer."""
    count = F.greatest(F.size(tokens) - (K - 1), F.least(F.size(tokens), F.lit(1)))
    return F.transform(
        F.slice(tokens, F.lit(1), count), lambda first, i: F.xxhash64(first, *[F.get(tokens, i + t) for t in range(1, K)])
    )


def _numbered(kmers: Column) -> Column:
    """(hash of k-mer and occurrence, place from 1) of every k-mer, packed and ascending."""
    ordered = F.sort_array(F.transform(kmers, lambda h, i: _pack(h, i + 1)))

    def number(x, occurrence):
        return _pack(F.xxhash64(_hash_of(x), occurrence), x.bitwiseAND(F.lit(_PLACES)))

    def split(held):
        def begins(x, i):
            return (i == 0) | (_hash_of(x) != _hash_of(F.get(held, i - 1)))

        first = F.transform(F.filter(held, begins), lambda x: number(x, F.lit(0)))
        return F.concat(first, _let(F.filter(held, lambda x, i: ~begins(x, i)), lambda again: F.flatten(_runs(again, number))))

    return F.sort_array(_let(ordered, split))


def _runs(again: Column, number: Callable[[Column, Column], Column]) -> Column:
    """Arrays of the later occurrences of each k-mer that has some, numbered from 1."""
    starts = _where(again, lambda x, i: (i == 0) | (_hash_of(x) != _hash_of(F.get(again, i - 1))))
    return _let(starts, lambda starts: F.transform(starts, lambda start, j: F.transform(
        F.slice(again, start + 1, F.coalesce(F.get(starts, j + 1), F.size(again)) - start),
        lambda x, before: number(x, before + 1),
    )))


def _tuples(kmers: Column, ring: Column) -> Column:
    """Per slot the hash of its TUPLE smallest k-mers in text order, cut to 16 bits."""
    begins = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda j: F.shiftleft(j.cast("long") * _SLOT_SPAN, _PLACE_BITS))
    # Places begin at 1, so a slot's begin equals no k-mer and sorts before those of its slot.
    marks = _where(F.sort_array(F.concat(ring, begins)), lambda x, i: x.bitwiseAND(F.lit(_IN_SLOT)) == 0)

    def of_slot(mark, j):
        places = F.transform(
            F.sequence(F.lit(0), F.lit(TUPLE - 1)),
            lambda t: F.get(ring, (mark - j + t) % F.size(ring)).bitwiseAND(F.lit(_PLACES)).cast("int"),
        )
        chosen = F.transform(F.sort_array(places), lambda place: F.get(kmers, place - 1))
        return F.xxhash64(chosen).bitwiseAND(F.lit(65535)).cast("int")

    return F.when(F.size(ring) > 0, F.transform(marks, of_slot)).otherwise(F.array().cast("array<int>"))


def fingerprint_text(slots: Column) -> Column:
    """The slots as four hexadecimal digits each; empty for a text without words."""
    return F.array_join(F.transform(slots, lambda s: F.lower(F.lpad(F.hex(s), 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots, 0 to 1; two texts without words are alike, one of them is not."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))
    return F.when(F.size(a) == F.size(b), F.coalesce(equal / F.nullif(F.size(a), F.lit(0)), F.lit(1.0))).otherwise(0.0)


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document with its fingerprint, an edited text and how alike both are.

    The edited text has the last half of the code points (rounded down) replaced by as many
    from the start of the next document's text, ascending by ``key`` (any number type), nulls
    first; after the last document comes the first. Rows of equal key are ordered by a hash
    of their texts. Null texts are empty; a single document is its own next one; an empty
    table gives no row. Other columns are not looked at.

    Columns: the key, ``text``, ``edited`` (texts), ``slots``, ``edited_slots``,
    ``next_slots`` (arrays; see ``fingerprint_text`` and ``likeness``).
    """
    held = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("key"), held.alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "bytes": F.octet_length("text")})
    paired = with_next(rows, "key", "tie", "bytes", {"slots": order_minhash(F.col("text"))}, {"next_text": "text", "next_slots": "slots"})
    half = F.floor(F.length("text") / 2).cast("int")
    edited = paired.withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    )
    return edited.select(
        F.col("key").alias(key), "text", "edited", "slots", order_minhash(F.col("edited")).alias("edited_slots"), "next_slots"
    )


def with_next(
    rows: DataFrame, key: str, tie: str, bytes_in: str, made: dict[str, Column], columns: dict[str, str]
) -> DataFrame:
    """Add columns of the next row, ascending by (key, tie), nulls first; the last one's next is the first.

    ``made`` names columns to compute for each row before; ``columns`` maps new names to
    those they come from; ``bytes_in`` names a size per row, ``tie`` a column of hashes.
    Rows meet in ranges of the numeric key, each sorted by itself; a key with more rows than
    a range should have is cut further by its hashes. The first row of a range is also sent
    to the range before it, so no window spans the table.
    """
    count, size = rows.agg(F.count(F.lit(1)), F.sum(F.col(bytes_in))).first()
    if not count:
        return rows.withColumns(made).select("*", *[F.col(old).alias(new) for new, old in columns.items()])
    cores = rows.sparkSession.sparkContext.defaultParallelism
    ranges = min(max(int(size or 0) // RANGE_BYTES + 1, 2 * cores), MAX_RANGES, count)
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    found = rows.agg(F.percentile_approx(key, shares, max(10_000, 8 * ranges))).first()[0] or []
    cuts = sorted(set(found))
    hot = sorted({c for a, c in zip(found, found[1:], strict=False) if a == c})
    at = F.col(key)
    # Where a key fills a range, it is the least one of it: its parts come before the others.
    part = F.when(at.isNull() | at.isin(hot), F.shiftright(F.col(tie), 56)).otherwise(F.lit(1 << 8)).cast("int")
    placed = rows.withColumns({"__range": F.when(at.isNull(), F.lit(-1)).otherwise(_count_up_to(at, cuts)), "__part": part})
    heads = (
        placed.groupBy("__range", "__part").agg(F.min(F.struct(F.col(key).alias("k"), F.col(tie).alias("t"))).alias("h"))
        .orderBy("__range", "__part").collect()  # one row per range, or per part of one
    )
    before = [(heads[i - 1]["__range"], heads[i - 1]["__part"], h["h"]["k"], h["h"]["t"]) for i, h in enumerate(heads)]
    kind = rows.schema[key].dataType.simpleString()
    known = rows.sparkSession.createDataFrame(before, f"__range int, __part int, __k {kind}, __t long")
    # At most MAX_RANGES keys, and 256 for each that fills a range.
    same = F.col(key).eqNullSafe(F.col("__k")) & (F.col(tie) == F.col("__t"))
    closing = rows.join(F.broadcast(known), same).drop("__k", "__t")
    both = placed.withColumn("__closes", F.lit(0)).unionByName(closing.withColumn("__closes", F.lit(1)))
    both = both.repartition(max(ranges, 2 * cores), "__range", "__part")  # tasks of one size at any size of the table
    order = Window.partitionBy("__range", "__part").orderBy("__closes", key, tie)
    following = both.withColumns(made).withColumns({new: F.lead(old).over(order) for new, old in columns.items()})
    return following.where("__closes = 0").drop("__range", "__part", "__closes")


def _count_up_to(x: Column, cuts: list) -> Column:
    """How many of the ascending cuts are <= x, by halving. The cuts are named once, so the
    expression grows with their number only."""
    if not cuts:
        return F.lit(0)
    ordered = F.array(*[F.lit(c) for c in cuts])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])

    def halve(low, step):  # low + step cuts are <= x if the last of them is
        return low + F.when(F.coalesce(F.get(ordered, low + step - 1) <= x, F.lit(False)), step).otherwise(0)

    return F.aggregate(steps, F.lit(0), halve)
