"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0..1.  Its integral is
the source's demand; the source's documents, in an order fixed by a digest of
the id, meet that demand one after the other, and inverting the cumulative
demand gives each document the time at which it is trained on.  A source whose
demand exceeds its size starts again from its first document, up to ``epochs``
passes; what a source cannot meet even so is shared among the others by weight.

A pass over a document is taken if the middle of the document lies within the
source's demand, so a source's taken words differ from its target by at most
half a document.

Everything is DataFrame code.  Running totals are taken per (source, bucket of
the digest) so that a source holding most rows is spread over many tasks; only
bucket sums, not rows, meet in one place.

Defined results: null text has size 0; documents of size 0 are taken 0 times
(``taken`` 0) with a null position; the null source is a source of its own,
ordered last; repeated rows are rows of their own; an empty table gives an
empty result.  If no source has words all targets are 0.  Extra columns are
kept by :func:`mix` and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_HEX = 3  #: digits of the digest that name a bucket: 4,096 buckets a source


def words(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, epochs: int = 3) -> DataFrame:
    """mix_target and mix_from of each row (mix_name, mix_source, mix_total).

    Sources by code point, null last, weigh 1, 2, 3, repeating.  Sources are
    capped in the order of size over weight, so the water level has a closed
    form: a source is capped if filling it takes less than its share of what
    the sources capped before it left.  ``mix_from`` is the time at which its
    schedule starts: the k-th class of weights enters later and ends at 1.
    """
    listed = sizes.where(F.col("mix_total").isNotNull())
    whole = Window.partitionBy(F.lit(1))
    by_name = whole.orderBy(F.col("mix_source").asc_nulls_last())
    # One row a source from here on: the list of sources, not of documents.
    weighed = listed.withColumn("mix_weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    fill = whole.orderBy((F.col("mix_total") / F.col("mix_weight")), F.col("mix_source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    grown = weighed.withColumns({
        "mix_all": F.sum("mix_total").over(whole).cast("double"),
        "mix_cap": (F.col("mix_total") * epochs).cast("double"),
        "mix_left_weight": F.sum("mix_weight").over(whole) - F.coalesce(F.sum("mix_weight").over(before), F.lit(0.0)),
        "mix_used": F.coalesce((F.sum("mix_total").over(before) * epochs).cast("double"), F.lit(0.0)),
    })
    level = (F.col("mix_all") - F.col("mix_used")) / F.col("mix_left_weight")
    capped = grown.withColumn("mix_capped", F.col("mix_cap") <= level * F.col("mix_weight"))
    # The first source that is not capped sets the level for all after it.
    rest = F.min(F.when(~F.col("mix_capped"), F.struct((F.col("mix_total") / F.col("mix_weight")).alias("a"), level.alias("level")))).over(whole)
    full = F.col("mix_rest").isNull() | (F.col("mix_total") / F.col("mix_weight") < F.col("mix_rest.a"))
    target = F.when(full, F.col("mix_cap")).otherwise(F.least("mix_cap", F.col("mix_rest.level") * F.col("mix_weight")))
    return capped.withColumn("mix_rest", rest).select("mix_name", "mix_source", "mix_total", target.alias("mix_target"), ((F.col("mix_weight") - 1) / 6).alias("mix_from"))


def _time(share: Column, start: Column) -> Column:
    """Inverse of a source's cumulative demand, ``share`` in 0..1 of its target.

    The schedule is 0 before ``start`` and rises linearly to the end, with half
    of its mean as offset: the integral is a quadratic in (t - start)/(1 - start).
    """
    u = (F.sqrt(F.lit(0.25) + 2 * share) - 0.5)  # solves u/2 + u*u/2 = share
    return start + (1 - start) * u


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epochs: int = 3) -> DataFrame:
    """id, size, source_size, target, passes, taken and position of every row."""
    rows = _rows(docs, F.col(id_col), id_col, text_col, source_col)
    return _planned(rows, epochs).select(F.col("mix_row").alias(id_col), "size", "source_size", "target", "passes", "taken", "position")


def _rows(docs: DataFrame, kept: Column, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """What is planned: ``kept`` as mix_row, the source, a never-null name for it, size, order key."""
    source = F.col(source_col).cast("string")
    name = F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return docs.select(kept.alias("mix_row"), source.alias("mix_source"), name.alias("mix_name"), words(F.col(text_col)).alias("size"), key.alias("mix_key"), F.substring(key, 1, _HEX).alias("mix_bucket"))


def _planned(rows: DataFrame, epochs: int) -> DataFrame:
    """``rows`` with source_size, target, passes, taken, position and what times follow from."""
    sums = rows.groupBy("mix_name", "mix_source", "mix_bucket").agg(F.sum("size").alias("mix_sum"))
    upto = Window.partitionBy("mix_name").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("mix_name", "mix_bucket", F.coalesce(F.sum("mix_sum").over(upto), F.lit(0)).alias("mix_offset"))
    goal = targets(sums.groupBy("mix_name", "mix_source").agg(F.sum("mix_sum").alias("mix_total")), epochs)
    known = offsets.join(goal.drop("mix_source"), "mix_name")
    within = Window.partitionBy("mix_name", "mix_bucket").orderBy("mix_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.drop("mix_source").withColumn("mix_before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(known, ["mix_name", "mix_bucket"])
    middle = F.col("mix_offset") + F.col("mix_before") + F.col("size") / 2
    passes = F.lit(0)
    for p in range(epochs):
        passes = passes + F.when((F.col("size") > 0) & (middle + p * F.col("mix_total") <= F.col("mix_target")), 1).otherwise(0)
    placed = placed.withColumns({"mix_middle": middle, "passes": passes, "source_size": F.col("mix_total"), "target": F.col("mix_target")})
    return placed.withColumns({"taken": F.col("size") * F.col("passes"), "position": F.when(F.col("passes") > 0, _position(F.lit(0)))})


def _position(p: Column) -> Column:
    """Training time of the p-th pass of a planned row."""
    share = F.least(F.lit(1.0), (F.col("mix_middle") + p * F.col("mix_total")) / F.col("mix_target"))
    return _time(share, F.col("mix_from"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epochs: int = 3) -> DataFrame:
    """The mixture itself: the columns of ``docs``, one row a pass, range-sorted by position."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    planned = _planned(_rows(docs, whole, id_col, text_col, source_col), epochs).where("passes > 0")
    times = F.transform(F.sequence(F.lit(0), F.col("passes") - 1), _position)
    return planned.select("mix_row", "mix_key", F.explode(times).alias("mix_at")).orderBy("mix_at", "mix_key").select("mix_row.*")
