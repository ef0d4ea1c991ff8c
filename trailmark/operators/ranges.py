"""Joins on a key and overlapping ranges, by time buckets.

A join on a patient alone makes all pairs of that patient's events before the range predicate cuts them down, and puts a patient
with a third of all rows into one task. Here each side is listed under the buckets of time that its range touches and the join is
on (keys, bucket): partners are near in time, and a long history is many join keys. A pair meets in several buckets but is
reported in the first that both have. Where lengths are unknown or mixed, each range has buckets about as long as itself (join_by_length).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(x: Column, width: int | Column) -> Column:
    """The number of the bucket of a time; exact for longs, unlike the quotient of two doubles."""
    return F.round((x - F.pmod(x, F.lit(width).cast("long"))) / width).cast("long")


def _listed(df: DataFrame, lo: Column, hi: Column, width: int, side: str) -> DataFrame:
    first, last = bucket(lo, width), bucket(hi, width)
    return df.withColumn(f"_first_{side}", first).withColumn("_bucket", F.explode(F.sequence(first, F.greatest(first, last))))


def join_ranges(left: DataFrame, right: DataFrame, keys: list[str], left_range: tuple[Column, Column], right_range: tuple[Column, Column], width: int) -> DataFrame:
    """Pairs with equal keys whose closed ranges overlap; columns of both sides, keys once. Column names must differ otherwise.
    Ranges must be bounded; width is the buckets' length, best about the ranges' own."""
    l, r = _listed(left, *left_range, width, "l"), _listed(right, *right_range, width, "r")
    r = r.withColumn("_r_lo", right_range[0]).withColumn("_r_hi", right_range[1])
    l = l.withColumn("_l_lo", left_range[0]).withColumn("_l_hi", left_range[1])
    met = l.join(r, [*keys, "_bucket"]).filter("_l_lo <= _r_hi AND _l_hi >= _r_lo AND _bucket = greatest(_first_l, _first_r)")
    return met.drop("_bucket", "_first_l", "_first_r", "_l_lo", "_l_hi", "_r_lo", "_r_hi")


def semi_join_range(left: DataFrame, right: DataFrame, keys: list[str], point: Column, right_range: tuple[Column, Column], width: int, condition: Column) -> DataFrame:
    """The rows of left, once each, that some row of right with equal keys meets the condition with. The condition must imply that left's point lies in right's
    closed range: only right is listed under several buckets, so that rows of left need no distinct afterwards. Key names must be left's only."""
    low, high = right_range
    listed = right.filter(low <= high).withColumn("_bucket", F.explode(F.sequence(bucket(low, width), bucket(high, width))))
    listed = listed.select("_bucket", *(F.col(k).alias(f"_r_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = condition & (bucket(point, width) == F.col("_bucket"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    return left.join(listed, on, "left_semi")


def semi_join_ranges(left: DataFrame, right: DataFrame, keys: list[str], left_range: tuple[Column, Column], right_range: tuple[Column, Column], width: int) -> DataFrame:
    """The rows of left whose closed range overlaps that of some row of right with equal keys, as often as in which buckets they meet. Column names must differ but for keys."""
    l = left.withColumns({"_l_lo": left_range[0], "_l_hi": left_range[1]}).withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_l_lo"), width), bucket(F.col("_l_hi"), width))))
    r = right.select(*(F.col(k).alias(f"_r_{k}") for k in keys), right_range[0].alias("_r_lo"), right_range[1].alias("_r_hi")).filter("_r_lo <= _r_hi")
    r = r.withColumn("_r_bucket", F.explode(F.sequence(bucket(F.col("_r_lo"), width), bucket(F.col("_r_hi"), width))))
    on = (F.col("_bucket") == F.col("_r_bucket")) & (F.col("_l_lo") <= F.col("_r_hi")) & (F.col("_l_hi") >= F.col("_r_lo"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    return l.join(r, on, "left_semi").select(*left.columns)


def join_by_start(left: DataFrame, right: DataFrame, keys: list[str], left_range: tuple[Column, Column], right_range: tuple[Column, Column], width: int) -> DataFrame:
    """As join_ranges, for ranges that are long or of many lengths: of two that overlap, the one that begins later begins inside the other. So one side is listed
    under its buckets and the other only where it begins, once for each side: no pair meets twice."""
    l = left.withColumns({"_l_lo": left_range[0], "_l_hi": left_range[1]})
    r = right.withColumns({"_r_lo": right_range[0], "_r_hi": right_range[1]})
    whole = lambda df, side: df.filter(f"_{side}_lo <= _{side}_hi").withColumn("_bucket", F.explode(F.sequence(bucket(F.col(f"_{side}_lo"), width), bucket(F.col(f"_{side}_hi"), width))))
    start = lambda df, side: df.filter(f"_{side}_lo <= _{side}_hi").withColumn("_bucket", bucket(F.col(f"_{side}_lo"), width))
    on = [*keys, "_bucket"]
    begins = whole(l, "l").join(start(r, "r"), on).filter("_r_lo BETWEEN _l_lo AND _l_hi")
    begun = start(l, "l").join(whole(r, "r"), on).filter("_r_lo < _l_lo AND _l_lo <= _r_hi")
    return begins.unionByName(begun).drop("_bucket", "_l_lo", "_l_hi", "_r_lo", "_r_hi")


#: Each level's buckets are so many times as long as those of the level below it; times are below 2 ** LONGEST.
STEP_BITS, LONGEST = 2, 60


def join_by_length(left: DataFrame, right: DataFrame, keys: list[str], left_range: tuple[Column, Column], right_range: tuple[Column, Column], width: int) -> DataFrame:
    """As join_by_start, for ranges of any lengths: each is listed under the at most two buckets it touches on the level of its own length, and where the other side
    begins is listed once on each level. width is the length of the buckets of the lowest level."""
    (l_lo, l_hi), (r_lo, r_hi) = left_range, right_range
    levels = max((LONGEST - width.bit_length()) // STEP_BITS, 0) + 2
    level = lambda lo, hi: sum(((hi - lo > width << (STEP_BITS * k)).cast("int") for k in range(levels - 1)), F.lit(0))

    def whole(df: DataFrame, lo: Column, hi: Column) -> DataFrame:
        own = df.filter(lo <= hi).withColumn("_level", level(lo, hi))
        size = F.call_function("shiftleft", F.lit(width).cast("long"), F.col("_level") * STEP_BITS)
        return own.withColumn("_bucket", F.explode(F.sequence(bucket(lo, size), bucket(hi, size))))

    def starts(df: DataFrame, lo: Column, hi: Column) -> DataFrame:
        each = (F.struct(F.lit(k).alias("_level"), bucket(lo, width << (STEP_BITS * k)).alias("_bucket")) for k in range(levels))
        return df.filter(lo <= hi).select("*", F.inline(F.array(*each)))

    on = [*keys, "_level", "_bucket"]
    begins = whole(left, l_lo, l_hi).join(starts(right, r_lo, r_hi), on).filter(r_lo.between(l_lo, l_hi))
    begun = starts(left, l_lo, l_hi).join(whole(right.filter(r_lo < r_hi), r_lo, r_hi), on).filter((r_lo < l_lo) & (l_lo <= r_hi))
    return begins.unionByName(begun).drop("_level", "_bucket")
