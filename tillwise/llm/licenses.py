"""License statements by diagonal voting.

Every pair of consecutive words of a document is joined by its hash to the places where that pair stands in a
template. Matches of one template vote for a diagonal, the document position minus the template position.
Neighbouring diagonals are merged, so a statement with a word more or less is still one span, and spans are
verified by their length and the share of the template's pairs they hold. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases and labels whose every place is reported.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Statements of the method's own labels, as words.
STATEMENTS = {
    "apache": "licensed under the apache license version 2 0",
    "mit": "released under the mit license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "gpl-3": "licensed under the gnu general public license version 3",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "public-domain": "this work has been dedicated to the public domain",
}
#: Share of a statement's word pairs that a span must hold, and how far diagonals of one span may lie apart.
MIN_SHARE, MAX_SHIFT = 0.75, 2


def lower_ascii(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def template_pairs(spark) -> DataFrame:
    """One row per word pair of each template: fixed and small."""
    rows = []
    for text, label in [*((t, n) for t, n in PHRASES.items()), *((t, n) for n, t in STATEMENTS.items())]:
        words = text.split(" ")
        for i in range(len(words) - 1):
            rows.append((text, label, text in PHRASES, len(words), i, words[i], words[i + 1]))
    schema = "template string, label string, base boolean, size int, place int, first string, second string"
    return spark.createDataFrame(rows, schema).withColumn("pair", F.xxhash64("first", "second"))


def license_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts all places of the phrases, the two word columns are the smallest and largest of their starts (null if
    none), ``labels`` adds the statements found, ``score`` is the largest verified share of any template (1 for a phrase).
    A null text counts as empty; documents without words, or with one, have no matches. Rows with null or repeated ids
    stay apart; extra columns are ignored; an empty table gives no rows.

    Templates are fixed and few, so their pairs are broadcast and no document is shuffled; only matches are.
    """
    spark = docs.sparkSession
    words = F.regexp_extract_all(lower_ascii(F.col(text_column)), F.lit(WORD), F.lit(0))
    source = docs.select(F.col(id_column).alias("doc_id"), F.monotonically_increasing_id().alias("row"), words.alias("words"))
    zipped = F.arrays_zip(F.col("words").alias("first"), F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))).alias("second"))
    pairs = source.select("doc_id", "row", F.size("words").cast("long").alias("n_words"), F.posexplode_outer(zipped).alias("at", "p"))
    pairs = pairs.select("doc_id", "row", "n_words", "at", F.col("p.first").alias("w1"), F.col("p.second").alias("w2"))
    pairs = pairs.withColumn("pair", F.xxhash64("w1", "w2"))
    templates = template_pairs(spark)
    same = (pairs["pair"] == templates["pair"]) & (pairs["w1"] == templates["first"]) & (pairs["w2"] == templates["second"])
    hits = pairs.join(F.broadcast(templates), same, "left")
    # Votes of a diagonal; a document's first pair keeps its row even without a hit.
    hits = hits.where(F.col("template").isNotNull() | (F.coalesce("at", F.lit(0)) == 0))
    diagonal = (F.col("at") - F.col("place")).cast("long")
    votes = hits.groupBy("row", "doc_id", "n_words", "template", "label", "base", "size", diagonal.alias("diagonal")).agg(
        F.count(F.lit(1)).alias("pairs"), F.min("at").alias("low"), F.max("at").alias("high")
    )
    lane = W.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(lane) > F.lit(MAX_SHIFT)
    # A phrase's diagonals are exact places; a statement's neighbouring ones are one span.
    fresh = F.when(F.col("base") | F.coalesce(apart, F.lit(True)), 1).otherwise(0)
    spans = votes.withColumn("span", F.sum(F.when(F.col("template").isNull(), 0).otherwise(fresh)).over(lane))
    spans = spans.groupBy("row", "doc_id", "n_words", "template", "label", "base", "size", "span").agg(
        F.sum("pairs").alias("pairs"), F.min("diagonal").alias("start"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    need = F.col("size") - 1
    length = F.col("high") - F.col("low") + 1
    # A span much longer than its template is scattered words, not a statement.
    share = F.when(length <= need + 2 * MAX_SHIFT, F.least(F.col("pairs"), need)).otherwise(F.lit(0)) / need
    found = F.col("template").isNotNull() & F.when(F.col("base"), F.col("pairs") == need).otherwise(share >= MIN_SHARE)
    place = F.col("base") & (F.col("pairs") == need)
    joined = lambda condition: F.concat_ws(",", F.array_sort(F.collect_set(F.when(condition, F.col("label")))))
    return (
        spans.groupBy("row", "doc_id", "n_words")
        .agg(
            F.count(F.when(place, 1)).alias("n_base"),
            F.min(F.when(place, F.col("start"))).alias("first_word"),
            F.max(F.when(place, F.col("start"))).alias("last_word"),
            joined(place).alias("base_labels"),
            joined(found).alias("labels"),
            F.coalesce(F.max(F.when(found, F.when(F.col("base"), F.lit(1.0)).otherwise(share))), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
