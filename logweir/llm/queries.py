"""One query per operator, over whole tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm import language, toxicity
from logweir.llm.centroids import cluster
from logweir.llm.disclosure import KINDS, private_spans
from logweir.llm.divergence import judge
from logweir.llm.impact_topk import index_rows, top_k
from logweir.llm.line_dedup import dedup_lines
from logweir.llm.mixing import mix
from logweir.llm.pieces import Pieces, encode
from logweir.llm.range_max import rank
from logweir.llm.rows import table
from logweir.llm.simhash import near_duplicates
from logweir.llm.warc import round_trip
from logweir.llm.wordpiece import piece_sets, token_counts


def piece_file() -> str:
    """The SentencePiece model of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return encode(documents, Pieces.load(piece_file()), carry=["doc_id"])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = language.bucket(F.col("doc_id"), 4) == 2
    profiles = language.learn(documents.where(~held_out))
    found = language.predict(documents, profiles, carry=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    held_out = language.bucket(F.col("doc_id"), 5) == 0
    grammar = toxicity.learn(documents, labels.where(~held_out))
    scored = toxicity.score(documents, grammar, carry=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_clauses")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select(
        F.col("row_key").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        "refers_to",
        "intact",
    )


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return token_counts(documents, piece_sets(piece_file()), carry=["doc_id"])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), carry=["doc_id"]).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    best = top_k(index, index.where(F.col("id") % 20 == 0))
    return best.withColumnRenamed("id", "vec_id")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, items = (table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return rank(documents, items).withColumnRenamed("id", "doc_id")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_spans(table(spark, sf_dir, "documents"), carry=["doc_id"])
    kinds = (*KINDS, "term")
    named = F.transform(
        "spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    )
    base = F.filter(named, lambda s: ~s.startswith("term:"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in kinds],
        F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"),
        F.concat_ws(",", named).alias("spans"),
    )


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"), carry=["vec_id"]).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_language_id": op2_language_id,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_quality_rules": op6_quality_rules,
    "op7_mixing": op7_mixing,
    "op8_warc": op8_warc,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_exact_topk": op10_exact_topk,
    "op11_lexical_search": op11_lexical_search,
    "op12_pii": op12_pii,
    "op13_centroid_clustering": op13_centroid_clustering,
}

OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(line) AS line, unnest(places) AS place
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS line,
               range(len(string_split(coalesce(text, ''), chr(10)))) AS places FROM documents)),
keyed AS (
  SELECT doc_id, place, line,
    translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key)
SELECT doc_id, count(*) AS n_lines,
  count(*) FILTER (WHERE first < doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place)
    FILTER (WHERE first IS NULL OR first = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN firsts USING (key) GROUP BY doc_id
"""

OP8_SQL = """
WITH bytes AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
bits AS (
  SELECT page_id, octet_length(body) AS payload_bytes,
    CAST(CAST(unhex(sha1(body)) AS BIT) AS VARCHAR) AS bits FROM bytes),
named AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j:
      CAST(substr(bits, 5 * i + j + 1, 1) AS INTEGER) * (16 >> j)))::INTEGER, 1)), '')
    AS payload_digest FROM bits)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to, true AS intact
FROM (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM named)
"""

OP10_SQL = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id,
    CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
  FROM sound q JOIN sound d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored)
SELECT * FROM ranked WHERE rank <= 20
"""

OP11_SQL = r"""
WITH words AS (
  SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS row FROM documents)),
sizes AS (SELECT row, doc_id, count(*) AS n FROM words GROUP BY row, doc_id),
everything AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id)),
counts AS (
  SELECT row, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY row, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counts, everything GROUP BY term),
scored AS (
  SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) //
    (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN sizes USING (row), everything
  GROUP BY item_id, row, doc_id),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (
    PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20
"""

#: One round: every vector to its nearest centroid, then the floors of the means.
OP13_ROUND = """
near{i} AS MATERIALIZED (
  SELECT row, v, norm, arg_min(c, (d, c)) AS cluster, CAST(min(d) AS BIGINT) AS distance FROM (
    SELECT row, vectors.v, norm, c, norm - 2 * list_inner_product(vectors.v, w) + list_inner_product(w, w) AS d
    FROM vectors, cent{i}) GROUP BY row, v, norm),
"""
OP13_MOVE = """
sum{i} AS (
  SELECT cluster, place, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT cluster, unnest(v)::BIGINT AS x, unnest(range(64)) AS place FROM near{i}) GROUP BY cluster, place),
cent{j} AS MATERIALIZED (
  SELECT c, CASE WHEN m.mean IS NULL THEN w ELSE m.mean END AS w FROM cent{i} LEFT JOIN (
    SELECT cluster, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY place) AS mean FROM sum{i} GROUP BY cluster) m
  ON m.cluster = c),
"""
OP13_SQL = (
    """
WITH vectors AS MATERIALIZED (
  SELECT vec_id, v, list_inner_product(v, v) AS norm, row_number() OVER () AS row FROM (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
cent0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY name) - 1 AS c, v AS w FROM (
    SELECT sha256('2:' || vec_id) AS name, v FROM vectors ORDER BY name LIMIT 40)),
"""
    + "".join(OP13_ROUND.format(i=i) + OP13_MOVE.format(i=i, j=i + 1) for i in range(5))
    + OP13_ROUND.format(i=5)
    + """
named AS (
  SELECT c, sha256(array_to_string(list_transform(w, lambda x: CAST(x AS BIGINT)), ',')) AS sha FROM cent5)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance,
  CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256
FROM near5 JOIN vectors USING (row) JOIN named ON c = cluster
"""
)

ORACLES = {
    "op4_line_dedup": OP4_SQL,
    "op8_warc": OP8_SQL,
    "op10_exact_topk": OP10_SQL,
    "op11_lexical_search": OP11_SQL,
    "op13_centroid_clustering": OP13_SQL,
}
