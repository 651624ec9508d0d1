"""The thin ``opN_<name>`` queries, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import bpe_codec, embedding_dedup, exact_dedup, language_id, minhash_dedup, packing, quality, token_count, token_records, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"), carry={"text_sha256": F.sha2(exact_dedup.normalised(), 256)})


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op6_byte_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip_digests(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.page_languages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.token_records(_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    import corpus_pipeline

    own = (op1_minhash_near_dedup, op2_token_counts, op3_best_fit_packing, op4_exact_dedup, op5_embedding_near_dedup, op6_byte_bpe_codec, op7_url_filter, op8_language_id, op9_token_records, op10_quality_classifier)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


#: Components of the pairs ``links`` (a, b; both directions) over all ``ids``, as rows (id, component).
_COMPONENTS = """reach AS (SELECT id, id AS component FROM ids UNION SELECT l.a, r.component FROM reach r JOIN links l ON l.b = r.id),
            least AS (SELECT id, min(component) AS component FROM reach GROUP BY 1)"""


def _near_dedup_sql() -> str:
    """All pairs of documents that share a shingle, counted."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
            WITH RECURSIVE words AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
            sets AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s FROM words),
            ids AS (SELECT id, len(s) AS n FROM sets), grams AS (SELECT id, hash(g) AS g, g AS own FROM (SELECT id, unnest(s) AS g FROM sets)),
            pairs AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM grams x JOIN grams y ON x.g = y.g AND x.own = y.own AND x.id <> y.id GROUP BY 1, 2),
            links AS (SELECT a, b FROM pairs p JOIN ids i ON i.id = a JOIN ids j ON j.id = b WHERE 100 * p.n >= 85 * (i.n + j.n - p.n)),
            {_COMPONENTS}
            SELECT id AS doc_id, n AS n_shingles, component AS component_id, id = component AS kept FROM ids JOIN least USING (id)"""


def _vectors_sql() -> str:
    """All pairs of vectors."""
    return f"""
            WITH RECURSIVE own AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
            valid AS (SELECT id, v FROM own WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
            links AS (SELECT x.id AS a, y.id AS b FROM valid x JOIN valid y ON x.id <> y.id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.9),
            ids AS (SELECT id FROM own), {_COMPONENTS}
            SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, component AS component_id, id = component AS kept FROM least"""


def _url_sql() -> str:
    """The fixed rules, and all combinations of tokens of labelled pages, counted."""
    rules = sorted(url_filter.RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = lambda h, p: f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')"
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{value(h, p, v)}'" for h, p, v in rules) + " END"
    return rf"""
            WITH cut AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
            parts AS (SELECT row_number() OVER () AS row, page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
            own AS (SELECT row, page_id, host, path, {case(lambda h, p, v: h + p)} AS rule, {case(lambda h, p, v: v)} AS fixed, list_distinct(list_concat(
                CASE WHEN host = '' THEN [] ELSE list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: 'host:' || array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')) END,
                list_transform(list_filter(string_split(lower(path), '/'), lambda s: s <> ''), lambda s: 'path:' || regexp_replace(s, '[0-9]+', '#', 'g')),
                CASE WHEN regexp_extract(path, '\.([A-Za-z]{{1,5}})$', 1) = '' THEN [] ELSE ['end:' || lower(regexp_extract(path, '\.([A-Za-z]{{1,5}})$', 1))] END,
                list_transform(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda s: s <> ''), lambda s: 'query:' || regexp_extract(s, '^[^=]*')))) AS tokens FROM parts),
            known AS (SELECT doc_id, min(quality) = 0 OR max(toxic) = 1 AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
            labelled AS (SELECT list_sort(tokens) AS tokens, bad FROM own JOIN known ON doc_id = TRY_CAST(nullif(regexp_extract(path, '/(\d{{1,18}})(?:[./]|$)', 1), '') AS BIGINT) WHERE bad IS NOT NULL),
            sets AS (SELECT bad, list_filter(tokens, lambda t, i: (mask >> (i - 1)) & 1 = 1) AS held FROM (SELECT bad, tokens, unnest(range(1, 1 << len(tokens))) AS mask FROM labelled)),
            mined AS (SELECT held, avg(bad::INT) AS confidence FROM sets GROUP BY 1 HAVING sum(bad::INT) >= {url_filter.MIN_ROWS} AND avg(bad::INT) >= {url_filter.MIN_CONFIDENCE}),
            matched AS (SELECT row, max(confidence) AS confidence FROM own JOIN mined ON fixed IS NULL AND list_has_all(tokens, held) GROUP BY 1)
            SELECT page_id, host, path, rule, coalesce(fixed, CASE WHEN confidence IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, confidence FROM own LEFT JOIN matched USING (row)"""


def oracle_sql() -> dict[str, str]:
    """Where SQL is quick enough on whole tables; the rest is tested by brute force."""
    return {
        "op1_minhash_near_dedup": _near_dedup_sql(),
        "op5_embedding_near_dedup": _vectors_sql(),
        "op7_url_filter": _url_sql(),
        "op4_exact_dedup": r"""
            WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
            SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
                   doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
            FROM n""",
    }
