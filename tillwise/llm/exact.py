"""Exact duplicates by splitting documents on successive bytes, most significant first.

Round by round every undecided document shows the next block of its bytes; documents
of one group that show the same block stay together. A group of one is decided, and so is
a group whose texts have ended. Blocks grow by a constant factor, so the number of rounds
grows with the logarithm of the longest text. Bytes themselves are compared; no digest is.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.session import staged


def exact_groups(
    docs: DataFrame,
    carry: Sequence[str] | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    first_block: int = 64,
    growth: int = 8,
) -> DataFrame:
    """The columns named in ``carry`` (all, by default) with ``keep_id``, ``group_size`` and ``kept``.

    Of equal texts the row with the largest id stays; ``keep_id`` is its id. A null text counts as
    empty. Rows with null ids lose to others (``keep_id`` is null if all are null). If the same id and
    text occur in several rows, exactly one of them is kept. An empty table gives no rows. Extra columns
    pass through, but for columns that have one of the three names: the result's stand for them.

    Rows get their number in a table written first, so that a task that runs again cannot number them anew. Per round one
    count per (group, block) is shuffled, combined before the shuffle, so a group that holds a third of all rows costs
    one row per task. Undecided rows then meet the counts of undecided groups in a join whose large side Spark may
    split; whole texts move only there.
    """
    columns = docs.columns if carry is None else list(carry)
    columns = [c for c in columns if c.lower() not in ("keep_id", "group_size", "kept")]
    done = _split(docs, columns, id_column, text_column, first_block, growth)
    return done.toDF(*columns, "keep_id", "group_size", "kept")


def without_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", first_block: int = 64, growth: int = 8) -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all columns, whatever their names."""
    done = _split(docs, docs.columns, id_column, text_column, first_block, growth)
    return done.where("kept").drop("keep_id", "group_size", "kept").toDF(*docs.columns)


def _split(docs: DataFrame, columns: Sequence[str], id_column: str, text_column: str, first_block: int, growth: int) -> DataFrame:
    """The columns as c0, c1, ... with keep_id, group_size and kept; inside, no name of the caller's is in use."""
    named = list(dict.fromkeys([*columns, id_column, text_column]))
    at = {c: f"c{i}" for i, c in enumerate(named)}
    own, key, text = [at[c] for c in columns], at[id_column], at[text_column]
    carried = text_column in columns
    rows = docs.select(*(F.col(f"`{c}`").alias(at[c]) for c in named))
    rows = rows.withColumns({"row": F.monotonically_increasing_id(), "group": F.lit(0).cast("long")})
    rows = staged(rows, "numbered")
    start, width, done = 1, first_block, []
    while True:
        shown = rows.withColumns(
            {
                "block": F.substring(F.coalesce(F.col(text), F.lit("")).cast("binary"), start, width),
                "ended": F.octet_length(F.coalesce(F.col(text), F.lit(""))) < F.lit(start + width),
            }
        )
        keys = ["group", "block", "ended"]
        mark = F.struct(F.col(key).alias("id"), (-F.col("row")).alias("row"))
        counts = shown.groupBy(keys).agg(F.count(F.lit(1)).alias("group_size"), F.max(mark).alias("best"))
        counts = staged(counts.where("group_size > 1").withColumn("next", F.monotonically_increasing_id()), "groups")
        joined = shown.join(counts.hint("shuffle_hash"), keys, "left")
        single = F.col("group_size").isNull()
        result = joined.withColumns(
            {
                "keep_id": F.when(single, F.col(key)).otherwise(F.col("best.id")),
                "kept": single | F.col("best").eqNullSafe(mark),
                "group_size": F.coalesce("group_size", F.lit(1).cast("long")),
                "open": ~single & ~F.col("ended"),
            }
        ).withColumn("group", F.col("next"))
        if not carried:  # decided rows need their text no more
            result = result.withColumn(text, F.when(F.col("open"), F.col(text)))
        result = result.select(*at.values(), "row", "group", "keep_id", "group_size", "kept", "open")
        result = staged(result, "split")  # one write serves the decided rows and the next round
        done.append(result.where("not open").select(*own, "keep_id", "group_size", "kept"))
        rows = result.where("open").select(*at.values(), "row", "group")
        if rows.isEmpty():
            return functools.reduce(DataFrame.unionAll, done)
        start, width = start + width, width * growth
