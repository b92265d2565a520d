"""The registered queries of this subpackage: thin, each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .session import prepare


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _spread(prepare(spark).read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text"))))


def _spread(rows: DataFrame) -> DataFrame:
    """Over at least as many tasks as there are cores: a scan of few row groups is dealt out once, others stay."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import dedup_substrings

    out = dedup_substrings(_docs(spark, sf_dir), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    return simhash_groups(_docs(spark, sf_dir), shingle=4, radius=4, lanes=1)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import dedup_bytes

    out = dedup_bytes(_docs(spark, sf_dir), length=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import embedding_groups

    return embedding_groups(_vectors(spark, sf_dir), threshold=0.9)


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_inner

    return top_inner(_vectors(spark, sf_dir), k=5, every=50, factor=256)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_scores(_docs(spark, sf_dir), labels, folds=5, held_out=0, threshold=0.3)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(_docs(spark, sf_dir, "doc_id", "text", "lang"), folds=4, held_out=2)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    out = pack_documents(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), window=1024)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    out = dedup_lines(_docs(spark, sf_dir), run=3, words=8)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import decode_pieces, encode_pieces

    model = public_tokenizers.path("piece_bpe_32k.model")
    out = decode_pieces(encode_pieces(_docs(spark, sf_dir), model).drop("text"), model)
    return out.select("doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_substring_dedup": op5_substring_dedup, "op6_simhash": op6_simhash, "op9_suffix_dedup": op9_suffix_dedup, "op1_embedding_dedup": op1_embedding_dedup, "op10_top_k": op10_top_k, "op2_sentencepiece": op2_sentencepiece, "op3_quality": op3_quality, "op4_packing": op4_packing, "op8_line_dedup": op8_line_dedup, "op7_language_id": op7_language_id}
ORACLES: dict[str, str] = {
    "op1_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL)
WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r(x, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.x, r.m FROM r JOIN l ON l.y = r.x),
c AS (SELECT x, min(m) AS m FROM r GROUP BY x), k AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, c.m AS component_id, vec_id = c.m AS kept FROM embeddings JOIN c ON c.x = vec_id LEFT JOIN k ON k.x = vec_id""",
    "op5_substring_dedup": """WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, s, list_slice(ws, s, s + 19) AS q FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w)),
f AS (SELECT doc_id, s, min({'d': doc_id, 's': s}) OVER (PARTITION BY q) AS low FROM g),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM f WHERE {'d': doc_id, 's': s} > low),
per AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT w.doc_id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
sha256(coalesce(array_to_string(CASE WHEN n IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256 FROM w LEFT JOIN per ON per.doc_id = w.doc_id""",
    "op8_line_dedup": """WITH a AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
i AS (SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS s, regexp_replace(raw, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS t, len(regexp_extract_all(raw, '[^\\x20\\x09-\\x0D]+')) AS n FROM a WHERE regexp_matches(raw, '[^\\x20\\x09-\\x0D]')),
g AS (SELECT doc_id, s, t, lead(t, 1) OVER o AS t1, lead(t, 2) OVER o AS t2, n, lead(n, 1) OVER o AS n1 FROM i WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
m AS (SELECT doc_id, s, t, t1, t2, CASE WHEN n >= 8 THEN 1 WHEN n + n1 >= 8 THEN 2 WHEN t2 IS NOT NULL THEN 3 END AS size FROM g),
f AS (SELECT doc_id, s, size, min({'d': doc_id, 's': s}) OVER (PARTITION BY size, t, CASE WHEN size > 1 THEN t1 END, CASE WHEN size > 2 THEN t2 END) AS low FROM m WHERE size IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + size)) AS s FROM f WHERE {'d': doc_id, 's': s} > low),
lost AS (SELECT i.doc_id, i.k FROM i JOIN gone ON gone.doc_id = i.doc_id AND gone.s = i.s)
SELECT a.doc_id AS doc_id, count(i.k) AS n_lines, count(lost.k) AS n_removed, sha256(coalesce(string_agg(CASE WHEN lost.k IS NULL THEN raw END, chr(10) ORDER BY a.k), '')) AS kept_sha256
FROM a LEFT JOIN i ON i.doc_id = a.doc_id AND i.k = a.k LEFT JOIN lost ON lost.doc_id = a.doc_id AND lost.k = a.k GROUP BY a.doc_id""",
    "op9_suffix_dedup": """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
g AS (SELECT doc_id, s, b[s:s + 49] AS q FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS s FROM d)),
f AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY q) AS low FROM g) WHERE doc_id > low),
r AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM
(SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 50 THEN 0 ELSE 1 END AS fresh FROM f)),
p AS (SELECT doc_id, min(s) AS lo, max(s) + 50 AS hi FROM r GROUP BY doc_id, run),
k AS (SELECT doc_id, lo, hi, lag(hi, 1, 1) OVER (PARTITION BY doc_id ORDER BY lo) AS since FROM p),
c AS (SELECT doc_id, count(*) AS n, sum(hi - lo) AS gone, max(hi) AS last, list({'a': since, 'z': lo - 1} ORDER BY lo) AS stays FROM k GROUP BY doc_id)
SELECT d.doc_id AS doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
sha256(CASE WHEN n IS NULL THEN b ELSE from_hex(array_to_string(list_transform(stays, lambda x: CASE WHEN x.z < x.a THEN '' ELSE hex(b[x.a:x.z]) END), '') || CASE WHEN last > octet_length(b) THEN '' ELSE hex(b[last:octet_length(b)]) END) END) AS kept_sha256
FROM d LEFT JOIN c ON c.doc_id = d.doc_id""",
    "op10_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s) SELECT * FROM r WHERE rank <= 5""",
}
