"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import binary_codes, bpe, exact_dedup, html_extract, mixing, ngram_join, pii_crf, prefix_trie, quality_fm, quality_rules, sharding, url_filter, whitening
from folio.llm.frames import documents


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str, listed: DataFrame | None = None) -> DataFrame:
    """`listed`: the blocked urls, in a column url; without it, pages of a few known host names stand in."""
    pages = _pages(spark, sf_dir)
    return url_filter.filter_urls(pages, url_filter.listed_urls(pages) if listed is None else listed)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(_pages(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op4_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_crf.find_personal_data(documents(spark, sf_dir))

    def written(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_kind(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [of_kind(k) for k in pii_crf.KINDS]
    every = F.size("spans").cast("long")
    more = [every.alias("n_spans"), (every - F.size("base_spans")).alias("n_added"), (every > 0).alias("has_personal_data")]
    return found.select("doc_id", *counts, F.sha2(written("base_spans"), 256).alias("base_sha256"), written("spans").alias("spans"), *more)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(documents(spark, sf_dir))


def op7_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(bpe.encode_documents(documents(spark, sf_dir), decode=True))


def bpe_digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of the encoder's and the decoder's output."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).drop("source")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_binary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = binary_codes.nearest_to_some(_embeddings(spark, sf_dir))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_embeddings(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_filters, op2_html_extraction, op3_quality_rules, op4_pii_crf, op5_sharding, op6_exact_dedup, op7_quality_fm, op8_bpe, op9_ngram_join, op10_mixing, op11_prefix_trie, op12_binary_codes, op13_whitening)
}


def _url_sql() -> str:
    host = "translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    bare = "regexp_replace(regexp_replace(host, ':(?:80|443)$', ''), '^(?:www|m)\\.', '')"
    trimmed = "regexp_replace(regexp_replace(path, '/index\\.html?$', '/'), '/+$', '')"
    parts = "list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_[a-z]+|ref|fbclid|gclid)=')))"
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1]) - len(r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in rules]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, rules, strict=True)) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, rules, strict=True)) + " END"
    names = "|".join(url_filter.BLOCKED_NAMES)
    return f"""
WITH a AS (SELECT page_id, url, {host} AS host, {path} AS path FROM pages),
b AS (SELECT *, {bare} || {trimmed} || CASE WHEN len({parts}) > 0 THEN '?' || array_to_string({parts}, '&') ELSE '' END AS canonical FROM a),
l AS (SELECT DISTINCT canonical FROM b WHERE host <> '' AND regexp_matches(host, '(?:^|\\.)(?:{names})(?:\\.|$)'))
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
    l.canonical IS NOT NULL AS listed
FROM b LEFT JOIN l ON host <> '' AND b.canonical = l.canonical"""


_DEDUP_SQL = r"""
WITH a AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
b AS (SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS size FROM a
    WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, size AS group_size, place = 1 AS kept, h AS text_sha256 FROM b"""

_TRIE_SQL = """
WITH t AS (SELECT conv_id, {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS turn, turn AS n, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(turn ORDER BY n NULLS FIRST, r, sha256(length(r) || ':' || r || x)) AS turns FROM t GROUP BY conv_id),
-- CRC-32 of the decimal id, bit by bit
h AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295) % 9 AS h FROM own),
p AS (SELECT a.conv_id, list_concat(coalesce(list_slice(b.turns, 1, a.h), []), list_slice(a.turns, a.h + 1, len(a.turns))) AS path
    FROM h a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
m AS (SELECT conv_id, path, len(path) AS n, unnest(range(0, len(path) + 1)) AS depth FROM p),
g AS (SELECT list_slice(path, 1, depth) AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM m GROUP BY ALL),
k AS (SELECT list_slice(node, 1, depth - 1) AS node, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY 1),
f AS (SELECT g.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(g.node[-1].x) END AS own FROM g LEFT JOIN k ON k.node = g.node),
a AS (SELECT list_slice(node, 1, up) AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens
    FROM (SELECT node, n_children, own, unnest(range(0, depth + 1)) AS up FROM f) GROUP BY 1)
SELECT f.conv_id, f.depth, g.conv_id AS parent_conv_id, f.n_convs, f.n_children, a.n_leaves, a.saved_tokens, f.ends_sha256
FROM f JOIN a ON a.node = f.node LEFT JOIN g ON f.depth > 0 AND g.node = list_slice(f.node, 1, f.depth - 1)"""

#: The codes find all of the true neighbours of the test tables.
_NEAREST_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, v.vec_id, list_distance(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id AND len(v.e) = len(q.e))
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM d WINDOW w AS (PARTITION BY query_id ORDER BY score, vec_id) QUALIFY row_number() OVER w <= 10"""

ORACLES: dict[str, str] = {"op1_url_filters": _url_sql(), "op6_exact_dedup": _DEDUP_SQL, "op11_prefix_trie": _TRIE_SQL, "op12_binary_codes": _NEAREST_SQL}
