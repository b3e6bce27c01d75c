"""Market baskets: frequent itemsets and association rules."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, Window as W, functions as F

from tillwise.functions.numeric import ratio
from tillwise.session import staged


def baskets(lines: DataFrame, order: str = "OrderNumber", item: str = "SubcategoryName", min_support: float | None = None) -> DataFrame:
    """Distinct items of every order as a sorted array.

    With ``min_support`` items that cannot be frequent are removed first; the
    orders that lose all items keep an empty basket, so support is unchanged.
    A frequent item occurs in at least that share of orders, which bounds the
    basket length no matter how many lines one order has.
    """
    pairs = lines.filter(F.col(order).isNotNull() & F.col(item).isNotNull()).select(order, item).distinct()
    if min_support is not None:
        # Written once: the number of orders, the counts of items and the baskets all read it.
        pairs = staged(pairs, "pairs")
        total = pairs.select(F.count_distinct(order)).first()[0]
        frequent = (
            pairs.groupBy(item).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= F.lit(total) * min_support)
        )
        # A written table has a known size, so the few frequent items do not cost a shuffle of all pairs.
        frequent = staged(frequent.select(item, F.lit(True).alias("_keep")), "frequent")
        pairs = pairs.join(frequent, item, "left")
        kept = F.when(F.col("_keep"), F.col(item))
    else:
        kept = F.col(item)
    return pairs.groupBy(order).agg(F.array_sort(F.collect_set(kept)).alias("items"))


# Sets of up to three items are counted one by one if that gives no more rows than so many per item of a basket, and per basket.
_COUNTED, _ROWS_PER_ITEM, _ROWS_PER_BASKET = 3, 32, 1 << 20


def _subsets(basket: DataFrame, size: int, known: DataFrame | None = None) -> DataFrame:
    """All sets of ``size`` items of every basket as columns i0, i1, ...; ``known`` holds the frequent sets of one item less."""
    names = [f"i{k}" for k in range(size)]
    rows = basket.select(F.col("items").alias("rest"))
    for k, name in enumerate(names):
        if known is not None and k == size - 1:
            match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.get("known", F.lit(i))) for i, c in enumerate(names[:k])])
            rows = rows.join(known.select(F.col("items").alias("known")), match, "left_semi")
        rows = rows.select(*names[:k], "rest", F.posexplode("rest").alias("at", name))
        rows = rows.select(*names[: k + 1], F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"))
    return rows.select(*names)


def frequent_itemsets(basket: DataFrame, min_support: float = 0.01, partitions: int | None = None) -> DataFrame:
    """(items, freq, support) of every itemset reaching ``min_support``.

    Small sets are counted directly, combined before the shuffle, as long as baskets are short enough for that; larger ones
    are found by parallel FP-growth over the items that occur in a frequent set of the largest size counted. A larger
    frequent set holds no other item, so nothing is lost, and without such sets there is nothing left to mine.
    """
    basket = staged(basket.select(F.array_sort("items").alias("items")), "baskets")
    n = F.size("items").cast("double")
    # Sets of k items of all baskets, and of the largest one.
    ways = [reduce(lambda a, b: a * b, [(n - i) / (i + 1) for i in range(k)]) for k in range(1, _COUNTED + 1)]
    facts = basket.agg(
        F.count(F.lit(1)).alias("total"), F.count("items").alias("filled"),
        F.count_if(F.size(F.array_distinct("items")) < F.size("items")).alias("repeated"),
        F.array(*[F.sum(F.when(F.size("items") > 0, w)) for w in ways]).alias("ways"), F.array(*[F.max(w) for w in ways]).alias("most"),
    ).first()
    if facts["repeated"]:
        raise ValueError(f"{facts['repeated']} baskets hold an item more than once")
    least = math.ceil(min_support * facts["filled"])
    counted = 0
    if facts["filled"] and facts["ways"][0] is not None:
        fits = [w <= _ROWS_PER_ITEM * facts["ways"][0] and m <= _ROWS_PER_BASKET for w, m in zip(facts["ways"], facts["most"])]
        counted = fits.index(False) if False in fits else _COUNTED
    found, level = [], None
    for size in range(1, counted + 1):
        names = [f"i{k}" for k in range(size)]
        counts = _subsets(basket, size, level).groupBy(*names).agg(F.count(F.lit(1)).alias("freq"))
        level = staged(counts.filter(F.col("freq") >= least).select(F.array(*names).alias("items"), "freq"), f"sets{size}")
        found.append(level)
        if level.isEmpty():
            break
    else:
        found.append(_grown(basket, level, counted, least, facts["filled"], partitions))
    return reduce(DataFrame.unionByName, found).select(
        F.array_sort("items").alias("items"), "freq", ratio(F.col("freq"), F.lit(facts["total"])).alias("support")
    )


def _grown(basket: DataFrame, level: DataFrame | None, counted: int, least: int, filled: int, partitions: int | None) -> DataFrame:
    """(items, freq) of the sets of more than ``counted`` items that occur ``least`` times, by FP-growth."""
    rows, n = basket.filter(F.col("items").isNotNull()), filled
    if level is not None:
        useful = level.select(F.explode("items").alias("item")).agg(F.collect_set("item")).scalar()
        rows = staged(rows.select(F.array_intersect("items", useful).alias("items")).filter(F.size("items") > counted), "baskets")
        n = rows.count()
    empty = basket.select("items", F.lit(0).cast("long").alias("freq")).limit(0)
    if n < max(least, 1):
        return empty
    # Half a basket below the bound, as the miner rounds up.
    miner = FPGrowth(itemsCol="items", minSupport=max(least - 0.5, 0.0) / n, minConfidence=1.0)
    if partitions is not None:
        miner = miner.setNumPartitions(partitions)
    sets = miner.fit(rows).freqItemsets
    return staged(sets.filter((F.size("items") > counted) & (F.col("freq") >= least)), "grown")


def of_size(itemsets: DataFrame, n: int, top: int | None = None) -> DataFrame:
    chosen = itemsets.filter(F.size("items") == n)
    return chosen if top is None else chosen.orderBy(F.desc("support"), F.asc("items")).limit(top)


def pair_matrix(itemsets: DataFrame) -> DataFrame:
    """Mean support of each ordered pair (first item, second item)."""
    return (
        of_size(itemsets, 2)
        .groupBy(F.element_at("items", 1).alias("item1"), F.element_at("items", 2).alias("item2"))
        .agg(F.avg("support").alias("support"))
    )


def rules(itemsets: DataFrame, min_lift: float = 1.0, min_confidence: float = 0.0) -> DataFrame:
    """Antecedent/consequent splits of every itemset that reach both bounds.

    Consequents grow by one item per round. Moving an item from the antecedent to the consequent can only lower the
    confidence, so a consequent is formed from two of its parts that reached ``min_confidence``, and a long itemset costs
    what its strong rules do. A row is one consequent of one itemset: no task holds all splits of a set. Supports are
    looked up in the itemset table, which holds every subset of a frequent set.
    """
    known = staged(itemsets.select(F.array_sort("items").alias("items"), "support").withColumn("id", F.monotonically_increasing_id()), "itemsets")
    antecedent = known.select(F.col("items").alias("antecedents"), F.col("support").alias("antecedent_support"))

    def scored(candidates: DataFrame) -> DataFrame:
        split = candidates.withColumn("antecedents", F.array_except("items", "consequents")).join(antecedent, "antecedents")
        split = split.withColumn("confidence", ratio(F.col("support"), F.col("antecedent_support")))
        return staged(split.filter(F.col("confidence") >= min_confidence), "rules")

    sized = known.filter(F.size("items") >= 2)
    level = scored(sized.select("id", "items", "support", F.explode("items").alias("last")).withColumn("consequents", F.array("last")))
    found, size = [level], 1
    while not level.filter(F.size("items") > size + 1).isEmpty():
        # Two consequents that differ in their last item only; items are sorted, so each union arises once.
        grow = level.filter(F.size("items") > size + 1).withColumn("head", F.slice("consequents", 1, size - 1))
        other = grow.select("id", "head", F.col("last").alias("next"))
        pairs = grow.select("id", "items", "support", "head", "consequents", "last").join(other, ["id", "head"]).filter("last < next")
        level = scored(pairs.select("id", "items", "support", F.col("next").alias("last"), F.concat("consequents", F.array("next")).alias("consequents")))
        found.append(level)
        size += 1
    consequent = known.select(F.col("items").alias("consequents"), F.col("support").alias("consequent_support"))
    every = reduce(DataFrame.unionByName, found).join(consequent, "consequents")
    every = every.withColumn("lift", ratio(F.col("confidence"), F.col("consequent_support")))
    return every.filter(F.col("lift") >= min_lift).select(
        "antecedents", "consequents", "antecedent_support", "consequent_support", "support", "confidence", "lift"
    )


def significant_rules(rule_table: DataFrame, min_confidence: float = 0.3, min_lift: float = 1.0, digits: int | None = 2) -> DataFrame:
    """Strong rules, one per itemset (best lift, then confidence, then antecedent).

    A rule and its reverse have the same lift up to rounding noise, so lifts are
    compared to nine digits.
    """
    strong = rule_table.filter((F.col("confidence") > min_confidence) & (F.col("lift") > min_lift))
    whole = F.array_sort(F.array_union("antecedents", "consequents"))
    best = W.partitionBy("_set").orderBy(
        F.round("lift", 9).desc(), F.round("confidence", 9).desc(), F.asc("antecedents")
    )
    one = (
        strong.withColumn("_set", whole)
        .withColumn("_rn", F.row_number().over(best))
        .filter(F.col("_rn") == 1)
        .drop("_set", "_rn")
    )
    text = {c: F.array_join(c, ", ") for c in ("antecedents", "consequents")}
    one = one.withColumns(text)
    if digits is None:
        return one
    numbers: Sequence[str] = ("antecedent_support", "consequent_support", "support", "confidence", "lift")
    return one.withColumns({c: F.bround(c, digits) for c in numbers})
