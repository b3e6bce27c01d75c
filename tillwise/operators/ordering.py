"""Exact order statistics and global row numbers that never sort everything in one task.

Quantiles are selected by histograms: a scan counts rows per bucket of values, later ones re-read
only the buckets that hold a wanted rank. Row numbers split a global ordering into blocks that
respect the order and rank rows inside a block. A window over counts sees one row per bucket;
row-level windows are partitioned by bucket, so a key that owns a third of the table is spread.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tillwise.session import staged

# Resolution of the logarithmic first buckets, per key and over everything; splits of a full bucket, rows that make one full.
_PER_LOG, _PER_LOG_OVERALL = 64.0, 4096.0
_SPLITS = 1024
FULL = 1 << 20


def _wanted(probs: Sequence[float]) -> Column:
    """Ranks on both sides of each quantile's place ``h`` among n values."""
    ends = []
    for i, p in enumerate(probs):
        h = F.lit(float(p)) * (F.col("n") - 1)
        ends += [F.struct(F.lit(i).alias("i"), h.alias("h"), end(h).cast("long").alias("rank")) for end in (F.floor, F.ceil)]
    return F.array_distinct(F.array(*ends))


def _holding(counts: DataFrame, by: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Buckets (lo, hi, c rows) that hold a wanted rank, with these ranks and the number of values before the bucket.

    Within ``by`` the buckets are ordered by value; ``start`` values lie before the first.
    """
    upto = W.partitionBy(*by).orderBy("lo").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = counts.withColumn("before", F.col("start") + F.sum("c").over(upto) - F.col("c")).withColumn("ranks", _wanted(probs))
    inside = F.filter("ranks", lambda r: (r["rank"] >= F.col("before")) & (r["rank"] < F.col("before") + F.col("c")))
    return placed.withColumn("ranks", inside).filter(F.size("ranks") > 0)


def _first_hits(rows: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    """The first buckets that hold a wanted rank: keys, lo, hi, c, before and n, the number of all values."""
    value = F.col("v")
    bucket = F.floor(F.signum(value) * F.log1p(F.abs(value)) * F.lit(_PER_LOG if keys else _PER_LOG_OVERALL)).cast("long")
    counts = rows.groupBy(*keys, bucket.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    total = F.sum("c").over(W.partitionBy(*keys).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    counts = counts.withColumns({"n": total, "start": F.lit(0).cast("long")})
    return _holding(counts, keys, probs).select(*keys, "lo", "hi", "c", "before", "n")


def _rows_in(rows: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (keys, v) that lie in one of the buckets, with the bucket's base, top, start and n.

    With keys the buckets are a written table: its size is known when the rows meet it, so it is broadcast while small
    and shuffled beyond. Without keys there are at most two per quantile, which reach the scan as one scalar subquery.
    """
    inside = (F.col("v") >= F.col("base")) & (F.col("v") <= F.col("top"))
    if not keys:
        few = hits.agg(F.collect_list(F.struct("lo", "hi", "before", "n"))).scalar()
        return rows.select("v", F.inline(few).alias("base", "top", "start", "n")).filter(inside)
    own = hits.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("lo").alias("base"), F.col("hi").alias("top"), F.col("before").alias("start"), "n")
    match = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_k_{k}")), keys, inside)
    return rows.join(own, match).select(*keys, "v", "base", "top", "start", "n")


def quantiles(
    df: DataFrame,
    value: Column | str,
    probs: Sequence[float],
    keys: Sequence[str] = (),
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per key (one row without keys); NULL and NaN are left out.

    The first scan counts rows per key and bucket of values, combined before the shuffle. Only rows of buckets that hold a
    wanted rank are read again, and counted value by value. With keys, the buckets found are written by a job that runs
    while the plan is built, and one of more than ``FULL`` rows is first cut in parts, as often as need be. Without keys
    nothing runs early, and finer buckets are read in two scans.
    """
    keys = list(keys)
    names = list(names or [f"q{i}" for i in range(len(probs))])
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, value.cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    hits = _first_hits(rows, keys, probs)
    if keys:
        hits = staged(hits, "buckets")
        while not hits.filter((F.col("lo") < F.col("hi")) & (F.col("c") > FULL)).isEmpty():
            share = F.coalesce(F.try_divide(F.col("v") - F.col("base"), F.col("top") - F.col("base")), F.lit(0.0))
            part = F.least(F.floor(share * _SPLITS), F.lit(_SPLITS - 1)).alias("part")
            counts = _rows_in(rows, hits, keys).groupBy(*keys, "base", "start", "n", part)
            counts = counts.agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            hits = staged(_holding(counts, [*keys, "base"], probs).select(*keys, "lo", "hi", "c", "before", "n"), "buckets")
    counts = _rows_in(rows, hits, keys).groupBy(*keys, "base", "start", "n", "v").agg(F.count(F.lit(1)).alias("c")).withColumn("lo", F.col("v"))
    points = _holding(counts, [*keys, "base"], probs).select(*keys, "v", F.inline("ranks"))
    ends = points.groupBy(*keys, "i").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("h").alias("h"))
    between = ends.withColumn("q", F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("h") - F.floor("h")))
    return between.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(n) for i, n in enumerate(names)])


def medians(df: DataFrame, values: dict[str, Column | str], keys: Sequence[str] = ()) -> DataFrame:
    """Exact medians of several expressions per key, joined into one row per key."""
    keys = list(keys)
    if not keys:
        result = None
        for name, value in values.items():
            one = quantiles(df, value, [0.5], names=[name]).scalar()
            row = df.sparkSession.range(1) if result is None else result
            result = row.withColumn(name, one)
        return result.drop("id")
    entries = [F.struct(F.lit(name).alias("m"), (F.col(v) if isinstance(v, str) else v).cast("double").alias("v")) for name, v in values.items()]
    stacked = df.select(*keys, F.inline(F.array(*entries)))
    long = quantiles(stacked, "v", [0.5], keys=[*keys, "m"], names=["q"])
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col("m") == name, F.col("q"))).alias(name) for name in values])

def mode_value(df: DataFrame, column: str) -> Column:
    """Most frequent value (smallest on ties) as a scalar subquery."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.desc("_n"), F.asc(column))
        .limit(1)
        .select(column)
        .scalar()
    )


def global_index(
    df: DataFrame, coarse: Column | str, fine: Sequence[Column | str], name: str = "row_index"
) -> DataFrame:
    """Number all rows from 0 in (coarse, fine) order.

    ``coarse`` must have bounded cardinality (a date, a prefix, a hash bucket);
    its counts give each block's offset, rows are numbered inside their block.
    """
    coarse = F.col(coarse) if isinstance(coarse, str) else coarse
    keyed = df.withColumn("_block", coarse)
    offsets = (
        keyed.groupBy("_block")
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn(
            "_offset",
            F.sum("_size").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, 0))
            - F.col("_size"),
        )
        .select(F.col("_block").alias("_offset_block"), "_offset")
    )
    within = W.partitionBy("_block").orderBy(*fine)
    return (
        keyed.withColumn("_in_block", F.row_number().over(within) - 1)
        .join(offsets, F.col("_block").eqNullSafe(F.col("_offset_block")))
        .withColumn(name, F.col("_offset") + F.col("_in_block"))
        .drop("_block", "_offset_block", "_offset", "_in_block")
    )


def permuted(number: Column, n: Column, seed: int | Column, rounds: int = 64) -> Column:
    """The place of ``number`` in a keyed permutation of 0 .. n-1, computed from the number alone.

    Each round pairs x with (k - x) mod n and, by a hash of the pair, swaps both or neither: a bijection for every n and
    seed, so that no table of the permutation and no walk back into the range is needed. ``n`` is no scalar subquery.
    """
    seed = F.lit(seed) if isinstance(seed, int) else seed

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(seed, r), n) - x, n)
        chosen = F.xxhash64(seed, r, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(chosen, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), number.cast("long"), swap)


def with_donors(df: DataFrame, key: Sequence[str], columns: Sequence[str], seed: int, repeats: int = 1, blocks: int = 1024) -> DataFrame:
    """Each row ``repeats`` times, with ``columns`` of another row in the struct ``_donor`` and the number of the ``_repeat``.

    Rows are numbered once, in a hash order of ``key``, and written; a keyed permutation of the numbers per repeat names the
    donors, so every row gives its values exactly once in each repeat. One join serves all columns.
    """
    order = F.xxhash64(F.lit(seed), *[F.col(k) for k in key])
    numbered = staged(global_index(df, F.pmod(order, F.lit(blocks)), [order, *key], "_slot"), "numbered")
    n = F.lit(max(numbered.count(), 1)).cast("long")
    takers = numbered.withColumn("_repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    takers = takers.withColumn("_from", permuted(F.col("_slot"), n, F.lit(seed) + F.col("_repeat"))).drop("_slot")
    givers = numbered.select(F.col("_slot").alias("_from"), F.struct(*columns).alias("_donor"))
    return takers.join(givers, "_from").drop("_from")


def shuffled_partner(df: DataFrame, key: Sequence[str], column: str, seed: int, blocks: int = 1024) -> DataFrame:
    """Replace ``column`` by the same values in a random but repeatable order."""
    paired = with_donors(df, key, [column], seed, blocks=blocks)
    return paired.withColumn(column, F.col("_donor")[column]).drop("_donor", "_repeat")


def top_groups(df: DataFrame, key: str, value: Column | str, n: int) -> DataFrame:
    """The ``n`` groups with the largest total (name breaks ties)."""
    value = F.col(value) if isinstance(value, str) else value
    return (
        df.groupBy(key)
        .agg(F.sum(value).alias("total"))
        .orderBy(F.desc("total"), F.asc(key))
        .limit(n)
    )


