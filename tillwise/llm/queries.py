"""Checked queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.llm.decontam import contamination
from tillwise.llm.exact import exact_groups
from tillwise.llm.extract import extract_pages
from tillwise.llm.lexical import ranked_search
from tillwise.llm.licenses import MAX_SHIFT, MIN_SHARE, PHRASES, STATEMENTS, license_scan
from tillwise.llm.mixing import mixing_rates
from tillwise.llm.negatives import hard_negatives
from tillwise.llm.packing import pack_documents
from tillwise.llm.simhash import near_groups
from tillwise.llm.suffixes import without_earlier
from tillwise.llm.topk import top_matches
from tillwise.llm.toxicity import toxicity_scores
from tillwise.llm.warc import archive_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_top_k_search",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
      FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored QUALIFY rank <= 5
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_matches(vectors, vectors.where("vec_id % 50 = 0"), k=5)


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def license_sql() -> str:
    """Places of all word pairs of the templates, diagonals, merged spans and shares."""
    rows = [(t, n, True) for t, n in PHRASES.items()] + [(t, n, False) for n, t in STATEMENTS.items()]
    templates = ", ".join(f"('{t}', '{n}', {base})" for t, n, base in rows)
    return f"""
    WITH templates AS (
      SELECT t, label, base, string_split(t, ' ') AS w FROM (VALUES {templates}) AS x(t, label, base)
    ),
    pairs AS (
      SELECT t, label, base, len(w) - 1 AS need, i AS place, w[i + 1] AS w1, w[i + 2] AS w2
      FROM templates, unnest(range(0, len(w) - 1)) AS r(i)
    ),
    docs AS (
      SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM documents
    ),
    found AS (SELECT doc_id, i AS spot, w[i + 1] AS w1, w[i + 2] AS w2 FROM docs, unnest(range(0, len(w) - 1)) AS r(i)),
    votes AS (
      SELECT doc_id, t, label, base, need, spot - place AS diagonal, count(*) AS pairs, min(spot) AS low, max(spot) AS high
      FROM found JOIN pairs USING (w1, w2) GROUP BY ALL
    ),
    fresh AS (
      SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER lane > {MAX_SHIFT}, true) THEN 1 ELSE 0 END AS f
      FROM votes WINDOW lane AS (PARTITION BY doc_id, t ORDER BY diagonal)
    ),
    numbered AS (SELECT *, sum(f) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS span FROM fresh),
    spans AS (
      SELECT doc_id, t, label, base, need, sum(pairs) AS pairs, min(diagonal) AS start, max(high) - min(low) + 1 AS length
      FROM numbered GROUP BY doc_id, t, label, base, need, span
    ),
    shares AS (
      SELECT *, CASE WHEN base THEN CASE WHEN pairs = need THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
                     WHEN length <= need + {2 * MAX_SHIFT} THEN least(pairs, need)::DOUBLE / need::DOUBLE ELSE 0.0 END AS share FROM spans
    ),
    verified AS (SELECT * FROM shares WHERE share >= CASE WHEN base THEN 1.0 ELSE {MIN_SHARE} END),
    summed AS (
      SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
      FROM verified GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
           coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
    FROM docs LEFT JOIN summed USING (doc_id)
    """


@query("op3_license_scan", license_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


@query(
    "op4_warc",
    """
    WITH p AS (
      SELECT page_id, encode(coalesce(html, '')) AS body, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
    ),
    h AS (SELECT *, sha1(body) AS hex FROM p)
    SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes,
           list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
             CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) % 32 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to, true AS verified
    FROM h
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


@query("op5_html_extraction")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


@query("op6_source_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_simhash_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


@query(
    "op8_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    grouped = exact_groups(docs.select("doc_id", "text", digest.alias("text_sha256")), carry=["doc_id", "text_sha256"])
    return grouped.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query(
    "op9_suffix_dedup",
    """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    windows AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM d, unnest(range(0, len(h) // 2 - 99)) AS t(p)),
    later AS (
      SELECT doc_id, p FROM windows QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1
    ),
    marked AS (
      SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh
      FROM later
    ),
    runs AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
    spans AS (SELECT doc_id, min(p) AS low, max(p) + 100 AS high FROM runs GROUP BY doc_id, run),
    pieces AS (
      SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS last_high FROM spans
    ),
    kept AS (
      SELECT doc_id, string_agg(substr(h, 2 * last_high + 1, 2 * (low - last_high)), '' ORDER BY low) AS head,
             max(high) AS tail, sum(high - low) AS n_removed, count(*) AS n_spans
      FROM pieces JOIN d USING (doc_id) GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
           CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
           sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_earlier(table(spark, sf_dir, "documents"), texts=False)


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def lowered(column: str) -> str:
    return f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op11_benchmark_decontamination",
    rf"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lowered("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    ),
    b AS (
      SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({lowered("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
    ),
    grams AS (
      SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS s
      FROM b, unnest(range(0, greatest(1, len(w) - 9))) AS t(i) WHERE len(w) > 0
    ),
    lengths AS (SELECT DISTINCT n FROM grams),
    windows AS (
      SELECT r, i, n, array_to_string(w[i + 1 : i + n], ' ') AS s FROM d CROSS JOIN lengths, unnest(range(0, len(w) - n + 1)) AS t(i)
    ),
    hits AS (SELECT DISTINCT r, i, n, item FROM windows JOIN grams USING (n, s)),
    covered AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(0, n)) AS u(j) GROUP BY r),
    listed AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query(
    "op12_ranked_search",
    rf"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lowered("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    ),
    b AS (
      SELECT DISTINCT item_id, unnest(regexp_extract_all({lowered("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
      FROM benchmark WHERE item_id IS NOT NULL
    ),
    totals AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(w)) AS BIGINT) AS nl FROM d WHERE len(w) > 0),
    tfs AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
    weights AS (
      SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight
      FROM tfs, totals GROUP BY term, nd
    ),
    sizes AS (SELECT r, doc_id, 100 - 90 + ((90 * CAST(len(w) AS BIGINT) * nd) // nl) AS m FROM d, totals WHERE len(w) > 0),
    scored AS (
      SELECT item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM b JOIN tfs USING (term) JOIN weights USING (term) JOIN sizes USING (r) WHERE doc_id IS NOT NULL GROUP BY item_id, r, doc_id
    )
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scored WHERE score > 0 QUALIFY rank <= 10
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@query(
    "op13_hard_negatives",
    """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    scored AS (
      SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
      FROM v AS a JOIN v AS c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.e) = len(c.e)
    ),
    positives AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT anchor_id, positive_id,
           CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    QUALIFY rank <= 5
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = vectors.select("vec_id", moved.alias("label"), "embedding")
    return hard_negatives(vectors, vectors.where("vec_id % 100 = 0"))
