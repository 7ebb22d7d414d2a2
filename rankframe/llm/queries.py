"""The queries of this subpackage over the shared tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankframe.llm import (
    embedding_dedup,
    html_extract,
    mixing,
    ngram_join,
    packing,
    quality_classifier,
    quality_rules,
    secret_scan,
    url_filter,
    warc,
)
from rankframe.llm.common import save, scratch_root

#: Tokenizer of the packing query; None: the public one that is installed.
TOKENIZER: str | None = None

#: Dated changes of the lists that op8 applies: (list, entry, action, day).
LIST_CHANGES = (
    ("spam", "spam-farm.example.org", "add", "2023-11-01"),
    ("spam", "spam-farm.example.org", "remove", "2024-03-15"),
    ("spam", "spam-farm.example.org", "add", "2024-07-01"),
    ("spam", "cheap-pills.example.com", "add", "2024-02-10"),
    ("spam", "cheap-pills.example.com", "add", "2024-02-20"),
    ("spam", "cheap-pills.example.com", "remove", "2024-10-01"),
    ("adult", "spam-farm.example.org", "add", "2024-05-01"),
    ("gambling", "casino-win.example.org", "add", "2024-01-20"),
    ("gambling", "casino-win.example.org", "remove", "2024-06-30"),
    ("gambling", "www.casino-win.example.org", "add", "2024-06-01"),
    ("gambling", "casino-win.example.org/en", "add", "2024-08-01"),
    ("takedown", "ththan.example.net", "add", "2024-04-01"),
    ("takedown", "blog.ththan.example.net/en", "add", "2024-01-01"),
    ("takedown", "blog.ththan.example.net/en", "remove", "2024-02-01"),
    ("mirror", "tionsh.example.net", "add", "2023-06-01"),
    ("mirror", "tionsh.example.net", "remove", "2024-04-20"),
    ("mirror", "tionsh.example.net/de", "add", "2024-03-01"),
    ("mirror", "tionsh.example.net/de", "remove", "2024-09-01"),
    ("mirror", "blog.tionsh.example.net/en", "add", "2024-08-15"),
    ("takedown", "thther.example.org", "add", "2024-02-15"),
    ("takedown", "thther.example.org", "remove", "2024-11-30"),
    ("takedown", "m.ththth.example.net/en/120", "add", "2023-12-01"),
    ("takedown", "tionsh.example.net/de/100066/archive/2023/12/31/morning/edition/page/2", "add", "2023-12-01"),
    ("spam", "tiontion.example.com", "add", "2024-05-05"),
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    if TOKENIZER:
        return TOKENIZER
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_html(_read(spark, sf_dir, "pages"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_read(spark, sf_dir, "documents"), words=3, num=9, den=10)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(_read(spark, sf_dir, "documents"), vocabulary=secret_scan.vocabulary_path())


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path())


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as captures: the table has no fetch time, so page_id tells the day of 2024."""
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int"))
    return _read(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("fetched"))


def list_changes(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{a}', '{b}', '{c}', date '{d}')" for a, b, c, d in LIST_CHANGES)
    return spark.sql(f"select * from values {rows} as t(list, entry, action, day)")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.filter_urls(captures(spark, sf_dir), list_changes(spark))
    return found.withColumn("fetched", F.col("fetched").cast("string"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_root(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"
    warc.write_archives(_read(spark, sf_dir, "pages"), path, compression="none")
    back = warc.read_archives(spark, path)
    digest = F.coalesce(F.sha2("payload", 256), F.when(F.col("record_type") == "revisit", F.col("digest")))
    back = save(back.select("page_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("n"), digest.alias("payload_digest")), "records")
    # What a revisit refers to was read back as well, and tells the length of its payload. Only
    # records that a revisit refers to are looked up.
    cited = back.where("refers_to is not null").select(F.col("refers_to").alias("id")).distinct()
    first = back.where("record_type = 'response' and page_id is not null").join(cited, F.col("page_id") == F.col("id"), "left_semi")
    first = first.groupBy(F.col("page_id").alias("id"), F.col("payload_digest").alias("d")).agg(F.min("n").alias("m"))
    a, b = back.alias("a"), save(first, "cited").alias("b")
    joined = a.join(b, (F.col("a.refers_to") == F.col("b.id")) & (F.col("a.payload_digest") == F.col("b.d")), "left")
    return joined.select("a.page_id", F.coalesce("a.n", "b.m").alias("payload_bytes"), "a.payload_digest", "a.record_type", "a.refers_to")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_read(spark, sf_dir, "documents"))


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op5."""
    return op5_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op7."""
    return op7_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op10."""
    return op10_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    every = (
        op1_html_extraction, op2_ngram_jaccard_join, op3_quality_classifier, op4_embedding_near_dedup, op5_secret_scans,
        op6_packing, op7_mixing, op8_url_filters, op9_warc, op10_quality_rules, secret_base_counts, mixing_targets, quality_base_counts,
    )
    return {f.__name__: f for f in every} | {"pipeline": corpus_pipeline.run}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_OP2 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 90 * (x.n + y.n - m)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = d.doc_id), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
"""

_SECRETS = r"""
SELECT doc_id,
  len(list_filter(regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access,
  len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""

_TARGETS = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size FROM documents),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1)),
c AS (SELECT *, CASE i % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 3.0::DOUBLE * source_size AS most FROM p),
o AS (SELECT *, most / w AS ratio, row_number() OVER (ORDER BY most / w, i) - 1 AS k FROM c),
l AS (
  SELECT o.ratio, o.k, ((SELECT sum(source_size) FROM o) - coalesce((SELECT sum(x.most) FROM o x WHERE x.k < o.k), 0)) / (SELECT sum(x.w) FROM o x WHERE x.k >= o.k) AS level FROM o),
level AS (SELECT (SELECT level FROM l WHERE ratio > level ORDER BY k LIMIT 1) AS level)
SELECT doc_id, size, source_size, round(least(most, coalesce(w * level, most)), 6) AS target
FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source, level
"""

_QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
v AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM v) WHERE c > 1),
n AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(8) t(k) GROUP BY 1),
q AS (
  SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls, coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN n USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM q
"""

_OP4 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id a, b.vec_id b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id,
  (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
  least(e.vec_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = e.vec_id), e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = e.vec_id), e.vec_id)) AS kept
FROM embeddings e
"""

_OP8 = f"""
WITH changes(list, entry, action, day) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}', DATE '{d}')" for a, b, c, d in LIST_CHANGES)}),
daily AS (SELECT list, entry, day, min(action = 'add') AS on_ FROM changes GROUP BY ALL),
turns AS (SELECT *, lag(on_) OVER (PARTITION BY list, entry ORDER BY day) AS before FROM daily),
ends AS (
  SELECT list, entry, on_, day AS valid_from, lead(day) OVER (PARTITION BY list, entry ORDER BY day) AS valid_to
  FROM turns WHERE on_ <> coalesce(before, false)),
caps AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetched,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^?#]*)', 1) AS path FROM pages),
hits AS (
  SELECT c.page_id, c.url, c.fetched, e.list, e.entry FROM caps c JOIN ends e
  ON e.on_ AND c.fetched >= e.valid_from AND (e.valid_to IS NULL OR c.fetched < e.valid_to)
  AND (c.host = e.entry OR c.host LIKE '%.' || e.entry OR c.host || '/' || c.path || '/' LIKE e.entry || '/%' AND contains(e.entry, '/'))),
found AS (
  SELECT page_id, url, fetched, count(DISTINCT list) AS n_lists, arg_min(entry, (-length(entry), entry)) AS entry
  FROM hits GROUP BY ALL)
SELECT c.page_id, c.url, CAST(c.fetched AS VARCHAR) AS fetched, f.n_lists IS NOT NULL AS blocked, coalesce(f.n_lists, 0) AS n_lists, f.entry
FROM caps c LEFT JOIN found f ON c.page_id = f.page_id AND c.url = f.url AND c.fetched = f.fetched
"""

_OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, strlen(body) AS n, sha256(body) AS d FROM p),
f AS (SELECT d, min(page_id) AS first FROM q WHERE n >= 100 GROUP BY d)
SELECT q.page_id, CAST(q.n AS BIGINT) AS payload_bytes, q.d AS payload_digest,
  CASE WHEN f.first IS NULL OR f.first = q.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first <> q.page_id THEN f.first END AS refers_to
FROM q LEFT JOIN f ON q.d = f.d AND q.n >= 100
"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    own = {
        "op2_ngram_jaccard_join": _OP2, "op4_embedding_near_dedup": _OP4, "op8_url_filters": _OP8, "op9_warc": _OP9,
        "secret_base_counts": _SECRETS, "mixing_targets": _TARGETS, "quality_base_counts": _QUALITY,
    }
    return own | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
