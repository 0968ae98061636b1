"""The operators applied to the tables, one query each, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html_extract, langid, minhash, mixing, pii, quality, token_counts, url_filter, warc
from .common import table

TOKENIZER = "byte_bpe_50k.tiktoken"


def tokenizer_path() -> str:
    import os

    folder = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
    return os.path.join(folder, TOKENIZER)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no block list; the urls of pages whose id is that of a row labelled toxic stand in for one."""
    pages = table(spark, sf_dir, "pages")
    bad = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("page_id")).distinct()
    return url_filter.judge_urls(pages, pages.select("page_id", "url").join(bad, "page_id", "left_semi").select("url"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, whole texts; see pii.find() for nulls, empty texts and repeated ids."""
    return pii.find(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items; see decontam.find_leaks()."""
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, whole html; see html_extract.extract()."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length histogram of all documents and its sums; see token_counts.token_limits()."""
    return token_counts.token_limits(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written, normalised and read back; see warc.round_trip()."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, links from 85 %; see minhash.near_duplicates()."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; see quality.judge_quality()."""
    return quality.judge_quality(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; see langid.identify()."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; see mixing.plan_copies()."""
    return mixing.plan_copies(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_url_filter, op2_pii, op3_decontamination, op4_html, op5_token_counts, op6_warc, op7_minhash, op8_quality, op9_language, op10_mixing)}


_W = r"[^\x20\x09-\x0D]+"
_CANON = """
  SELECT *, regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)$', '') AS h, regexp_replace(path, '/+$', '') AS p,
         list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'),
                               lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS q
  FROM (SELECT page_id, rest, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
        FROM (SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages))
"""
_RULES = [(h, p, v) for v, h, p in sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))]
_FIT = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for h, p, _ in _RULES]


def oracle_sql() -> dict[str, str]:
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (h, p, _) in zip(_FIT, _RULES, strict=True))
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, (_, _, v) in zip(_FIT, _RULES, strict=True))
    return {
        "op1_url_filter": f"""
WITH c AS ({_CANON}), k AS (SELECT *, CASE WHEN h <> '' THEN h || p || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS key FROM c),
bad AS (SELECT DISTINCT key FROM k WHERE key IS NOT NULL AND page_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
j AS (SELECT k.*, bad.key IS NOT NULL AS is_listed FROM k LEFT JOIN bad USING (key))
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN is_listed THEN 'block' ELSE 'allow' END AS verdict, is_listed FROM j""",
        "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, hex, min(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, payload_bytes,
       list_reduce(list_transform(range(0, 4), lambda g: list_reduce(list_transform(range(0, 8), lambda k:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(hex, 1 + g * 10, 10))::BIGINT >> (35 - 5 * k)) & 31)::INT), 1)), lambda a, x: a || x)), lambda a, x: a || x) AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM b""",
        "op7_minhash": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)""",
        "op10_mixing": f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_W}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM s),
f AS (SELECT *, (source_size * 3)::BIGINT AS cap, (source_size * 3)::DOUBLE / weight::DOUBLE AS fl FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY fl, rn) AS pos,
             coalesce(sum(cap) OVER (ORDER BY fl, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
             sum(weight) OVER (ORDER BY fl, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
             sum(source_size) OVER () AS total FROM f),
l AS (SELECT *, (total - used)::DOUBLE / open::DOUBLE AS lvl FROM p),
t AS (SELECT *, least(cap::DOUBLE, (SELECT arg_min(lvl, pos) FROM l WHERE lvl <= fl) * weight) AS target FROM l),
g AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0.0::DOUBLE END AS rate FROM t),
c AS (SELECT doc_id, size, source_size, target, rate, (floor(rate) + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, rate, copies, copies * size AS taken FROM c""",
    }
