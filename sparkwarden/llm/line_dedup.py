"""Line dedup by an exact set-similarity join, in DataFrame code only.

A line's tokens are its distinct five-word shingles (lower-cased; a line of
fewer words is one token; a blank line has none and is never removed).  Lines
are alike at Jaccard 0.8 or more.  A line is removed if an earlier line (smaller
id, or the same id and an earlier line number) is alike, kept or not.

1. One pass over the texts makes each line's tokens and stores, of its set
   ordered by hash, a slice a little longer than its prefix, the set's size and
   digests, and two 64-bit bitmaps.
2. Tokens of all slices are counted in a fixed number of hash buckets; the
   fullest sixteenth of the buckets is frequent.  Tokens are ordered by rarity:
   the others first, by hash, then frequent ones by their bucket's count.  Where
   too much of a slice is frequent to tell the prefix, the line's whole set is
   made again.
3. Lines with equal token sets form a class with its first place.
4. Classes meet on the tokens of their prefixes, in one exchange; tokens of one
   class only go no further.  Sets of three tokens or fewer stay out: only an
   equal set can be alike.
5. Each class is first held against the earliest class it shares a prefix token
   with, which settles groups of near copies with one comparison a class.  Only
   classes that are then left meet all earlier ones on their prefix tokens.
   Length and bitmap filters and a positional one (no more tokens can be in
   common than either set has from the meeting token on) bound the overlap
   before a pair is made.
6. What remains is verified on the full sets, which are made again for the first
   lines of the candidate classes only.
7. A class goes if an alike class starts earlier; other classes keep their
   first line.

Defined results: null and empty text have no token and stay as they are; rows
without an id keep all lines and are compared with nothing; an empty table gives
an empty result.  Of rows with equal ids each loses lines of its own text; their
lines of equal number are not earlier than one another, whatever the order of
the rows.  Extra columns are kept by :func:`drop_lines`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import stored

SHINGLE = 5
#: Similarity as a fraction, 8 / 10.
NUM, DEN = 8, 10
_BUCKETS = 1 << 14
#: One bucket in so many, the fullest ones, holds frequent tokens.
_FREQUENT = 16
#: Sets up to this size are alike to equal sets only.
_EQUAL_ONLY = NUM // (DEN - NUM) - 1
#: Up to so many rows of a few longs are broadcast; beyond that they are shuffled.
BROADCAST_ROWS = 1_000_000


def _plain(text: Column) -> Column:
    """Lower-cased, with blanks in place of all space but line ends."""
    plain = F.lower(text)
    for blank in "\t\x0b\x0c\r":
        plain = F.replace(plain, F.lit(blank), F.lit(" "))
    return plain


def tokens(line: Column) -> Column:
    """Hashes of the shingles of a line from :func:`_plain` text, repeats included."""
    words = F.array_remove(F.split(line, " "), "")
    # A one-entry array names the words, so that they are made once.
    return F.flatten(F.transform(F.array(words), _shingles))


def _shingles(w: Column) -> Column:
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)]))
    short = F.array(F.xxhash64(F.lit("short"), w))
    # With elements that are never null in all branches, sets are sorted and compared as plain longs.
    none = F.array().cast(ArrayType(LongType(), containsNull=False))
    return F.when(F.size(w) >= SHINGLE, grams).when(F.size(w) > 0, short).otherwise(none)


def _lines(docs: DataFrame, id_col: str, text_col: str, only: DataFrame | None = None) -> DataFrame:
    """(id, row, at, line): row is a digest of the text, line numbers count from 0.

    ``only`` names the ids of the documents that are looked at.
    """
    # The digest is made here, once a text, so that the text itself need not go along with its lines.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text")).where("id is not null")
    if only is not None:
        rows = rows.join(_light(stored(only.select("id").distinct(), "line-ids")), "id", "left_semi")
    return rows.select("id", "row", F.posexplode(F.split(_plain(F.col("text")), "\n")).alias("at", "line"))


def _light(rows: DataFrame) -> DataFrame:
    """Stored rows of a few longs, to be broadcast if there are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _table(values: Iterable[int], of: str) -> Column:
    """The numbers as a literal array; its items take a long as their index, without a cast."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{of}>")


def _parity(tokens: Column, half: int) -> Column:
    """Parities of the tokens at 64 bits; each token counts in one of two halves, by its bit 6."""
    signed = [1 << k for k in range(63)] + [-1 << 63]
    bit = _table([0] * 64 + signed if half else signed + [0] * 64, "long")
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda bits, t: bits.bitwiseXOR(bit[t.bitwiseAND(F.lit(127))]))


def _least_overlap(n: Column, num: int, den: int) -> Column:
    """ceil(n * num / den) in integers."""
    return ((n * num + (den - 1)) / den).cast("long")


def _prefix_size(n: Column) -> Column:
    return (n - _least_overlap(n, NUM, DEN) + 1).cast("int")


def token_set(line: Column) -> Column:
    """The line's distinct tokens in order of their hashes."""
    return F.sort_array(F.array_distinct(tokens(line)))


def _sliced(lines: DataFrame) -> DataFrame:
    """(id, row, at, uid, d1, d2, n, bits, bits2, slice) of every line; uid is its own, whatever is repeated."""
    sets = lines.select("id", "row", "at", token_set(F.col("line")).alias("set"))
    n, near = F.size("set"), F.size("set") > _EQUAL_ONLY
    bits = [F.when(near, _parity(F.col("set"), half)).alias(name) for half, name in enumerate(["bits", "bits2"])]
    some = F.slice("set", F.lit(1), _prefix_size(n) + F.floor(_prefix_size(n) / 4).cast("int") + 2)
    return sets.select("id", "row", "at", F.monotonically_increasing_id().alias("uid"), F.xxhash64("set").alias("d1"), F.hash("set").alias("d2"), n.alias("n"), *bits, F.when(near, some).alias("slice"))


def frequent(full: DataFrame) -> Column:
    """Rank of each bucket among those of frequent tokens, the fullest last, or 0, as a literal array.

    Counts cover the slices of all lines; what reaches the driver is one number a bucket.
    """
    token = full.select(F.explode("slice").alias("t"))
    counts = token.groupBy(F.col("t").bitwiseAND(F.lit(_BUCKETS - 1)).cast("int").alias("b")).count().collect()
    order = sorted(counts, key=lambda r: (-r["count"], r["b"]))
    often = [0] * _BUCKETS
    for k, r in enumerate(order[: _BUCKETS // _FREQUENT]):
        often[r["b"]] = _BUCKETS // _FREQUENT - k
    return _table(often, "int")


def _by_rarity(tokens: Column, often: Column) -> tuple[Column, Column]:
    """The tokens of an array that are rare and those that are frequent, each in its order."""

    def rank(t: Column) -> Column:
        return often[t.bitwiseAND(F.lit(_BUCKETS - 1))]

    ranked = F.transform(F.filter(tokens, lambda t: rank(t) > 0), lambda t: F.struct(rank(t).alias("r"), t.alias("t")))
    return F.filter(tokens, lambda t: rank(t) == 0), F.transform(F.array_sort(ranked), lambda x: x["t"])


def _prefixes(whole_lines: Callable[[DataFrame], DataFrame], reps: DataFrame, often: Column) -> DataFrame:
    """(id, at, n, bits, bits2, prefix) of the representatives, prefixes in order of rarity.

    A prefix may be null here if the line has another row with its prefix.
    ``whole_lines`` makes the lines of the documents with the given ids.
    """
    size = _prefix_size(F.col("n"))
    rare, hits = _by_rarity(F.col("slice"), often)
    part = F.size("slice") < F.col("n")
    again = reps.where(part & (F.size(rare) < size)).select("id", "row", "at", "n", "bits", "bits2")
    again = stored(again.dropDuplicates(["id", "row", "at"]), "line-again")
    # The one-entry array names the rare tokens, so that they are found once.
    prefix = F.transform(F.array(rare), lambda r: F.when(F.size(r) >= size, F.slice(r, F.lit(1), size)).when(~part, F.slice(F.concat(r, hits), F.lit(1), size)))
    out = reps.select("id", "at", "n", "bits", "bits2", F.get(prefix, 0).alias("prefix"))
    if again.isEmpty():
        return out
    found = whole_lines(again).join(_light(again), ["id", "row", "at"]).distinct().withColumn("set", token_set(F.col("line")))
    rare, hits = _by_rarity(F.col("set"), often)
    found = found.select("id", "at", "n", "bits", "bits2", F.slice(F.concat(rare, hits), F.lit(1), size).alias("prefix"))
    return out.unionByName(stored(found, "line-prefixes"))


def _representatives(full: DataFrame, copies: DataFrame) -> DataFrame:
    """One line of each class that can have near copies: the first."""
    both = full.where(F.col("n") > _EQUAL_ONLY).join(_light(copies.select("d1", "d2", "first_uid")), ["d1", "d2"], "left")
    return both.where(F.col("first_uid").isNull() | (F.col("uid") == F.col("first_uid")))


def _met(prefixes: DataFrame) -> DataFrame:
    """(token, id, at, n, bits, bits2, left, first) of each class and prefix token that another class has in its prefix.

    ``left`` is how many tokens the set has from this one on, in the order of
    tokens; ``first`` is the token's earliest class, with its size, bitmaps and rest.
    """
    posts = prefixes.select("id", "at", "n", "bits", "bits2", F.posexplode("prefix").alias("pos", "token"))
    # Line number and size share a long on the way.
    packed = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("n").cast("long"))
    posts = posts.select("token", "id", packed.alias("an"), "bits", "bits2", (F.col("n") - F.col("pos")).alias("left"))
    own = Window.partitionBy("token")
    ranked = posts.withColumns({"k": F.count(F.lit(1)).over(own), "first": F.min(F.struct("id", "an", "bits", "bits2", "left")).over(own)}).where("k > 1")

    def apart(of: str) -> list[Column]:
        an = F.col(f"{of}an")
        return [F.col(f"{of}id").alias("id"), F.shiftright(an, 32).cast("int").alias("at"), an.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("n"), *[F.col(of + c).alias(c) for c in ("bits", "bits2", "left")]]

    return ranked.select("token", *apart(""), F.struct(*apart("first.")).alias("first"))


def _near(a: str, b: str) -> Column:
    """Whether sizes, bitmaps and rests from a common token on allow a similarity of 8/10.

    The sets differ in a ninth of their sizes' sum or less.  Alike sets meet at
    their first common token too, which both have in their prefixes, and from
    there on each has all that is in common.
    """

    def both(name: str) -> tuple[Column, Column]:
        return F.col(f"{a}{name}"), F.col(f"{b}{name}")

    n1, n2 = both("n")
    odd = [F.bit_count(x.bitwiseXOR(y)) for x, y in (both("bits"), both("bits2"))]
    differ = (odd[0] + odd[1]) * (NUM + DEN) <= (n1 + n2) * (DEN - NUM)
    enough = F.least(*both("left")) * (NUM + DEN) >= (n1 + n2) * NUM
    return (F.least(n1, n2) * DEN >= F.greatest(n1, n2) * NUM) & enough & differ


def _place(at: str) -> Column:
    return F.struct(F.col(f"{at}.id").alias("id"), F.col(f"{at}.at").alias("at"))


def _earliest_pairs(met: DataFrame) -> DataFrame:
    """(e, l): each class's place with the earliest place it meets and may be alike to."""
    first = F.struct(F.col("first.id").alias("id"), F.col("first.at").alias("at"))
    own = F.struct("id", "at")
    return met.where((first < own) & _near("", "first.")).groupBy(own.alias("l")).agg(F.min(first).alias("e"))


def _pairs(met: DataFrame, settled: DataFrame) -> DataFrame:
    """(e, l): all other pairs of places that the filters leave, l not among the settled ones."""
    posts = met.drop("first")
    e, l = posts.alias("e"), posts.join(_light(settled), ["id", "at"], "left_anti").alias("l")
    both = e.join(l, (F.col("e.token") == F.col("l.token")) & (_place("e") < _place("l")) & _near("e.", "l."))
    return both.select(_place("e").alias("e"), _place("l").alias("l")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The later sets (l, d1) of pairs of places (e, l) whose full sets are similar enough."""
    left = sets.select(F.col("place").alias("e"), F.col("set").alias("se"))
    right = sets.select(F.col("place").alias("l"), "d1", F.col("set").alias("sl"))
    both = left.join(_light(pairs), "e").join(right, "l")
    common = F.size(F.array_intersect("se", "sl"))
    return both.where(common * DEN >= (F.size("se") + F.size("sl") - common) * NUM).select("l", "d1").distinct()


def _sets(whole_lines: Callable[[DataFrame], DataFrame], pairs: DataFrame) -> DataFrame:
    """(place, set, d1) of all places of the pairs, made again from the texts."""
    places = stored(pairs.select("e.id", "e.at").unionByName(pairs.select("l.id", "l.at")).distinct(), "line-places")
    found = whole_lines(places).join(_light(places), ["id", "at"], "left_semi").select("id", "at", "line").distinct()
    sets = found.select(F.struct("id", "at").alias("place"), token_set(F.col("line")).alias("set"))
    return stored(sets.withColumn("d1", F.xxhash64("set")), "line-sets").where(F.size("set") > _EQUAL_ONLY)


def _alike(whole_lines: Callable[[DataFrame], DataFrame], met: DataFrame) -> DataFrame:
    """(id, at, d1): places and digests of sets that have an earlier alike one.

    A place has several sets only if an id is repeated; such a place is not
    settled until all its pairs are verified.
    """
    earliest = stored(_earliest_pairs(met), "line-earliest")
    sets = _sets(whole_lines, earliest)
    first = stored(_verified(earliest, sets), "line-first")
    several = sets.groupBy("place").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("place").alias("l"))
    settled = stored(first.select("l").distinct().join(several, "l", "left_anti").select("l.id", "l.at"), "line-settled")
    pairs = stored(_pairs(met, settled).join(earliest, ["e", "l"], "left_anti"), "line-pairs")
    later = _verified(pairs, _sets(whole_lines, pairs))
    return first.unionByName(later).select("l.id", "l.at", "d1").distinct()


def flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, gone): of each text with a removed line, the numbers of these lines."""
    whole_lines = partial(_lines, docs, id_col, text_col)
    full = stored(_sliced(whole_lines()), "lines").where("n > 0")
    keys = full.select("id", "row", "at", "d1", "d2")
    copies = full.groupBy("d1", "d2").agg(F.min(F.struct("id", "at", "uid")).alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1")
    copies = stored(copies.select("d1", "d2", F.col("first.id").alias("first_id"), F.col("first.at").alias("first_at"), F.col("first.uid").alias("first_uid")), "line-copies")
    prefixes = _prefixes(whole_lines, _representatives(full, copies), frequent(full))
    near = stored(_alike(whole_lines, stored(_met(prefixes), "line-met")), "line-near")
    alike = stored(keys.join(_light(near), ["id", "at", "d1"], "left_semi").select("d1", "d2").distinct(), "line-alike")
    later = (F.col("id") != F.col("first_id")) | (F.col("at") != F.col("first_at"))
    both = keys.join(_light(copies), ["d1", "d2"], "left").join(_light(alike.withColumn("alike", F.lit(True))), ["d1", "d2"], "left")
    out = both.where(F.col("alike") | later)
    return out.groupBy("id", "row").agg(F.array_sort(F.collect_set("at")).alias("gone"))


def _kept_lines(text: Column, gone: Column) -> Column:
    """The text without the numbered lines; ``gone`` null: the text itself."""
    upto = F.transform(gone, lambda g, i: F.concat(F.array_repeat(F.lit(True), g - F.coalesce(F.get(gone, i - 1), F.lit(-1)) - 1), F.array(F.lit(False))))
    # Beyond the last removed line there is no mark, which is null.
    marked = F.zip_with(F.split(text, "\n"), F.flatten(upto), lambda line, keep: F.struct(line.alias("line"), keep.alias("keep")))
    kept = F.transform(F.filter(marked, lambda m: F.coalesce(m["keep"], F.lit(True))), lambda m: m["line"])
    return F.when(gone.isNull(), text).otherwise(F.array_join(kept, "\n"))


def _with_flags(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` as struct line_doc with the removed line numbers (null: none).

    The numbers go to where the texts are if they are few.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("line_doc"), F.col(id_col).cast("long").alias("line_id"), F.xxhash64(text_col).alias("line_row"))
    found = stored(flags(docs, id_col, text_col).select(F.col("id").alias("line_id"), F.col("row").alias("line_row"), "gone"), "line-flags")
    longs = found.agg(F.coalesce(F.sum(F.size("gone") + 2), F.lit(0))).first()[0]
    return whole.join(F.broadcast(found) if longs <= BROADCAST_ROWS else found, ["line_id", "line_row"], "left")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_lines, n_removed and SHA-256 of the kept text of every row."""
    both = _with_flags(docs, id_col, text_col)
    text = F.col("line_doc").getField(text_col)
    kept = _kept_lines(F.coalesce(text, F.lit("")), F.col("gone"))
    lines = F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.split(text, "\n")))
    return both.select(F.col("line_doc").getField(id_col).alias(id_col), lines.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.sha2(kept, 256).alias("kept_sha256"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_empty: bool = False) -> DataFrame:
    """``docs`` with the removed lines cut from the text.

    ``drop_empty`` leaves out documents that lost lines and have no word left.
    """
    both = _with_flags(docs, id_col, text_col)
    text = _kept_lines(F.col("line_doc").getField(text_col), F.col("gone"))
    fields = [text.alias(c) if c == text_col else F.col("line_doc").getField(c).alias(c) for c in docs.columns]
    out = both.select(F.col("gone").isNotNull().alias("line_lost"), F.struct(*fields).alias("line_doc"))
    if drop_empty:
        out = out.where(~F.col("line_lost") | F.col("line_doc").getField(text_col).rlike(r"[^\x20\x09-\x0D]"))
    return out.select("line_doc.*")
