"""The registered queries of this subpackage, and their SQL where SQL can express them.

Each query applies its operator with production parameters to the whole of its
tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import decontaminate, embedding_dedup, html_text, langid, mixing, near_dedup, sharding, substring_index, suffix_dedup, url_filter

#: Target weights of sources: the hot one has four times the share of any other.
WEIGHTS = {"src0": 4.0}
BLOCKED_DOMAINS = ("spam-farm.example.org", "cheap-pills.example.com")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each page's URL is blocked, by the URLs of pages labelled toxic and two known domains."""
    pages, labels = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels")
    toxic = pages.join(labels.where("toxic = 1"), F.col("page_id") == F.col("doc_id"), "left_semi").select(F.col("url").alias("entry"))
    known = spark.range(1).select(F.explode(F.array(*map(F.lit, BLOCKED_DOMAINS))).alias("entry"))
    return url_filter.filter_urls(pages, url_filter.build(spark, toxic.union(known)))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds half of, or more."""
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_substring_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that documents repeat of documents before them."""
    return substring_index.incremental_duplicates(_table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of each document."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents")).select("doc_id", "shard_id")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page."""
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, gap to the runner-up and ambiguity of each document."""
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding's class of near-duplicates and the number of its links."""
    return embedding_dedup.near_classes(_table(spark, sf_dir, "embeddings"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents served within the token budget, with their place in the stream."""
    return mixing.mix(_table(spark, sf_dir, "documents"), weights=WEIGHTS)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of near-duplicate groups and the document of each group that stays."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that several documents share."""
    return suffix_dedup.repeated_substrings(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_decontamination": op2_decontamination,
    "op3_substring_index": op3_substring_index,
    "op4_sharding": op4_sharding,
    "op5_html_extraction": op5_html_extraction,
    "op6_language_id": op6_language_id,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_mixing": op8_mixing,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
}

_MIXING_SQL = f"""
WITH d AS (
  SELECT doc_id, source, md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f]+')) AS BIGINT) AS n_tokens
  FROM documents),
b AS (SELECT CAST(floor(coalesce(sum(n_tokens), 0) * {mixing.BUDGET_SHARE}) AS BIGINT) AS budget FROM d),
f AS (
  SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS DOUBLE)
            / CASE {' '.join(f"WHEN source = '{s}' THEN {w}" for s, w in WEIGHTS.items())} ELSE 1.0 END AS finish
  FROM d),
s AS (
  SELECT *, CAST(sum(n_tokens) OVER (ORDER BY finish, source NULLS FIRST, k, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_tokens
  FROM f)
SELECT doc_id, source, n_tokens, finish, cum_tokens FROM s, b WHERE cum_tokens <= budget
"""

_PARTS = "regexp_extract({0}, '^[ \\t]*(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^#]*)', {1})"
_HOST = "regexp_replace(lower(" + _PARTS.format("url", 1) + "), '^www[.]', '')"
_URL_SQL = f"""
WITH u AS (SELECT page_id, {_HOST} AS h, {_HOST} || regexp_replace({_PARTS.format("url", 2)}, '[/ \\t]+$', '') AS n FROM pages),
r AS (
  SELECT DISTINCT n AS rule FROM u WHERE n <> '' AND page_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
  UNION SELECT unnest({list(BLOCKED_DOMAINS)})),
c AS (SELECT page_id, n AS cand, 0 AS o FROM u
      UNION ALL
      SELECT page_id, array_to_string(string_split(h, '.')[i:], '.'), i FROM (SELECT *, unnest(range(1, greatest(len(string_split(h, '.')) - 1, 1) + 1)) AS i FROM u)),
m AS (SELECT page_id, arg_min(rule, o) AS rule FROM c JOIN r ON cand = rule GROUP BY page_id)
SELECT page_id, rule IS NOT NULL AS blocked, rule FROM u LEFT JOIN m USING (page_id)
"""

_SIM = f"""
WITH RECURSIVE v AS (SELECT DISTINCT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
n AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id, e) AS k, id, e, sqrt(list_inner_product(e, e)) AS l FROM v),
p AS MATERIALIZED (SELECT x.k AS a, y.k AS b FROM n x JOIN n y ON x.k <> y.k AND len(x.e) = len(y.e) AND (x.e = y.e OR list_inner_product(x.e, y.e) / (x.l * y.l) >= {embedding_dedup.MIN_COSINE})),
reach AS (SELECT k, k AS r FROM n UNION SELECT p.b, reach.r FROM reach JOIN p ON p.a = reach.k),
c AS (SELECT reach.k, min(n.id) AS class_id FROM reach JOIN n ON n.k = reach.r GROUP BY reach.k)
SELECT n.id AS vec_id, c.class_id, (SELECT count(*) FROM p WHERE p.a = n.k) AS n_links FROM n JOIN c USING (k)
"""

_WORD = "[0-9a-z\\x{80}-\\x{10FFFF}]+"
_WORDS = f"regexp_extract_all(replace(replace(lower(text), '\u03c2', '\u03c3'), 'i\u0307', 'i'), '{_WORD}')"
# An item's grams have five words, or all of its words if it has fewer; a document's have as many as the items' have.
_DECONTAMINATION_SQL = f"""
WITH t AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
i AS (
  SELECT item_id, w, least(5, len(w)) AS k, unnest(list_distinct(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: list_aggregate(w[i:i + least(5, len(w)) - 1], 'string_agg', ' ')))) AS g
  FROM t WHERE len(w) > 0),
n AS (SELECT item_id, w, count(*) AS n FROM i GROUP BY item_id, w),
x AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
d AS (
  SELECT r, doc_id, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: list_aggregate(w[i:i + k - 1], 'string_agg', ' ')))) AS g
  FROM x, (SELECT DISTINCT k FROM i) WHERE len(w) >= k),
m AS (SELECT r, doc_id, item_id, w, count(*) AS c FROM i JOIN d USING (k, g) GROUP BY r, doc_id, item_id, w)
SELECT doc_id, item_id, round(max(c / n), 6) AS containment FROM m JOIN n USING (item_id, w) WHERE c / n >= {decontaminate.THRESHOLD} GROUP BY r, doc_id, item_id
"""

_N = sharding.N_SHARDS
_SHARDING_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END || '/' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {sharding.HEX_DIGITS}) AS g,
         coalesce(length(text), 0) AS s
  FROM documents),
g AS (SELECT g, sum(s)::BIGINT AS s FROM d GROUP BY g),
p AS (SELECT g, row_number() OVER (ORDER BY g) AS i, sum(s) OVER (ORDER BY g)::BIGINT AS c, s FROM g),
z AS (SELECT max(c) AS total, max(s) AS largest FROM p),
walk AS (
  SELECT greatest(largest, (total + {_N} - 1) // {_N}) AS lo, greatest(largest, (total + {_N} - 1) // {_N}) + largest AS hi,
         greatest(largest, (total + {_N} - 1) // {_N}) + largest // 2 AS cap, 0::BIGINT AS pos, 0 AS used
  FROM z
  UNION ALL
  SELECT CASE WHEN used = {_N} AND pos < total THEN cap + 1 ELSE lo END,
         CASE WHEN pos = total THEN cap ELSE hi END,
         CASE WHEN pos = total THEN (lo + cap) // 2 WHEN used = {_N} THEN (cap + 1 + hi) // 2 ELSE cap END,
         CASE WHEN pos = total OR used = {_N} THEN 0 ELSE (SELECT max(c) FROM p WHERE c <= pos + cap) END,
         CASE WHEN pos = total OR used = {_N} THEN 0 ELSE used + 1 END
  FROM walk, z WHERE lo < hi),
best AS (SELECT max(lo) AS cap FROM walk WHERE lo = hi),
cuts AS (
  SELECT 0 AS shard, 0::BIGINT AS a, (SELECT max(c) FROM p, best WHERE c <= cap) AS b
  UNION ALL
  SELECT shard + 1, b, (SELECT max(c) FROM p, best WHERE c <= cuts.b + cap) FROM cuts, z WHERE b < total)
SELECT doc_id, CAST(coalesce((SELECT max(shard) FROM cuts WHERE a < p.c), 0) AS INTEGER) AS shard_id FROM d JOIN p USING (g)
"""



def _repeats_sql(length: int, later_only: bool) -> str:
    """Spans of words covered by windows that other documents (or such of smaller ids) have."""
    return f"""
WITH x AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT r, doc_id, unnest(range(0, len(w) - {length} + 1)) AS s, w FROM x WHERE len(w) >= {length}),
h AS MATERIALIZED (SELECT r, doc_id, s, md5_number(list_aggregate(w[s + 1:s + {length}], 'string_agg', ' ')) AS g FROM p),
g AS (SELECT g, min(doc_id) AS first_doc FROM h GROUP BY g HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT r, doc_id, s, first_doc FROM h JOIN g USING (g){' WHERE first_doc < doc_id' if later_only else ''}),
o AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + {length} THEN 0 ELSE 1 END AS fresh FROM m),
q AS (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY s ROWS UNBOUNDED PRECEDING) AS span FROM o)
SELECT any_value(doc_id) AS doc_id, min(s) AS start_word, max(s) + {length} AS end_word, min(first_doc) AS first_doc FROM q GROUP BY r, span
"""


ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": _URL_SQL,
    "op2_decontamination": _DECONTAMINATION_SQL,
    "op3_substring_index": _repeats_sql(substring_index.LENGTH, True),
    "op4_sharding": _SHARDING_SQL,
    "op7_embedding_near_dedup": _SIM,
    "op8_mixing": _MIXING_SQL,
    "op10_suffix_dedup": _repeats_sql(suffix_dedup.LENGTH, False),
}
