"""Registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clicklens.functions.plan import local_rows
from clicklens.llm.centroids import cluster_report
from clicklens.llm.chat import COLON, END, ESCAPES, HEAD, conversation_report
from clicklens.llm.edit_counts import PATTERN, edited_counts, middle_edit
from clicklens.llm.near_dups import near_duplicates
from clicklens.llm.order_minhash import fingerprint_report
from clicklens.llm.quality import classify_quality
from clicklens.llm.secret_scan import secret_report
from clicklens.llm.sentencepieces import encode_pieces
from clicklens.llm.sharding import shard_report
from clicklens.llm.templates import contamination_report
from clicklens.llm.toxicity import classify_toxicity
from clicklens.llm.vector_codes import code_report
from clicklens.llm.warc import derivatives, response_records

VOCABULARIES = "/opt/tokenizers"

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


CONTROL_STRINGS = "\\### Assistant: </turn> ok"


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[function.__name__] = function
    return function


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups: 3-word shingles, Jaccard similarity of 0.85 or more."""
    return near_duplicates(read(spark, sf_dir, "documents"), words=3, percent=85)


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; rows of fold 1 of 3 are held out of training."""
    return classify_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; rows of fold 2 of 4 are held out of training."""
    return classify_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op6_edit_aware_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after the stated edit of its middle."""
    docs = read(spark, sf_dir, "documents")
    return edited_counts(docs, middle_edit, f"{VOCABULARIES}/byte_bpe_50k.tiktoken", PATTERN)


@query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, their number, and whether they decode to the text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_pieces(docs, f"{VOCABULARIES}/piece_bpe_32k.model").drop("text")


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known forms and high-entropy strings in every document."""
    return secret_report(read(spark, sf_dir, "documents"))


@query
def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash of every document and of its edited text."""
    return fingerprint_report(read(spark, sf_dir, "documents"))


@query
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document contains, also with other numbers and names."""
    return contamination_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings, formatted and read back."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = [(-7, i, role, CONTROL_STRINGS) for i, role in enumerate(("user", "assistant"))]
    return conversation_report(rows.unionByName(local_rows(spark, hard, rows.schema)))


@query
def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and plain-text records derived from a response record of every page."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return derivatives(response_records(pages, "2024-01-01T00:00:00Z").drop("url", "html"))


@query
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of 40 centroids for every vector, after five rounds."""
    return cluster_report(read(spark, sf_dir, "embeddings"))


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every vector: 16 parts, 64 entries each, after two rounds."""
    return code_report(read(spark, sf_dir, "embeddings"))


@query
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards of near equal bytes."""
    return shard_report(read(spark, sf_dir, "documents"))


_CONTROLS = "".join(raw for raw, _ in ESCAPES)
ORACLES["op5_chat_formatting"] = f"""
WITH rows AS (
    SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
    UNION ALL SELECT -7, 0, 'user', '{CONTROL_STRINGS}'
    UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_STRINGS}'
), filled AS (
    SELECT *, coalesce(role, '') AS r, coalesce(text, '') AS t,
        CASE WHEN role = 'assistant' THEN coalesce(text, '') ELSE '' END AS learned
    FROM rows
)
SELECT conv_id,
    count(*) AS n_turns,
    sha256(string_agg(r || chr(10) || t || chr(10), ''
        ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
    CAST(sum(length(learned)) AS BIGINT) AS loss_chars,
    sha256(string_agg(learned, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS loss_sha256,
    CAST(sum({len(HEAD + COLON + END)} + length(r) + length(t)
        + length(regexp_replace(r || t, '[^{_CONTROLS}]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM filled GROUP BY conv_id
"""

ORACLES["op4_minhash_near_dedup"] = """
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
        WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s
    FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_shared
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), linked AS (
    SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
    WHERE 100 * n_shared >= 85 * (x.n + y.n - n_shared)
), edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (
    SELECT doc_id AS id, doc_id AS low FROM documents
    UNION
    SELECT b, low FROM reach JOIN edges ON id = a WHERE low < b
), least AS (SELECT id, min(low) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least ON d.doc_id = id LEFT JOIN sizes s ON d.doc_id = s.doc_id
"""


def _cluster_sql(count: int = 40, rounds: int = 5, dims: int = 64) -> str:
    near = """near{n} AS (
    SELECT vec_id, v, arg_min(c, (d, c)) AS cluster, min(d) AS distance FROM (
        SELECT k.vec_id, k.v, m.c, list_sum(list_transform(list_zip(k.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
        FROM kept k, centroids{n} m) GROUP BY vec_id, v
)"""
    move = """places{m} AS (
    SELECT cluster AS c, i, floor(sum(x) / count(*))::BIGINT AS x FROM (
        SELECT cluster, unnest(v) AS x, unnest(range(len(v))) AS i FROM near{n}) GROUP BY cluster, i
), centroids{m} AS (
    SELECT c, coalesce(p.v, o.v) AS v FROM centroids{n} o
    LEFT JOIN (SELECT c, list(x ORDER BY i) AS v FROM places{m} GROUP BY c) p USING (c)
)"""
    steps = [near.format(n=0)]
    for n in range(rounds):
        steps += [move.format(n=n, m=n + 1), near.format(n=n + 1)]
    return f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dims}
), centroids0 AS (
    SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM kept
    QUALIFY c < {count}
), {", ".join(steps).replace(" AS (", " AS MATERIALIZED (")}
SELECT vec_id, cluster::INTEGER AS cluster, distance::BIGINT AS distance,
    (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
    (sum(distance) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM near{rounds} JOIN centroids{rounds} m ON c = cluster
"""


def _code_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    near = """near{n} AS (
    SELECT vec_id, label, p, v, arg_min(e, (d, e)) AS entry, min(d) AS d FROM (
        SELECT k.vec_id, k.label, k.p, k.v, b.e, list_sum(list_transform(list_zip(k.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM parts k JOIN books{n} b USING (p)) GROUP BY vec_id, label, p, v
)"""
    move = """places{m} AS (
    SELECT p, entry AS e, i, floor(sum(x) / count(*))::BIGINT AS x FROM (
        SELECT p, entry, unnest(v) AS x, unnest(range(len(v))) AS i FROM near{n}) GROUP BY p, entry, i
), books{m} AS (
    SELECT p, e, coalesce(f.v, o.v) AS v FROM books{n} o
    LEFT JOIN (SELECT p, e, list(x ORDER BY i) AS v FROM places{m} GROUP BY p, e) f USING (p, e)
)"""
    steps = [near.format(n=0)]
    for n in range(rounds):
        steps += [move.format(n=n, m=n + 1), near.format(n=n + 1)]
    return f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
), parts AS MATERIALIZED (
    SELECT vec_id, label, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS v FROM kept, range({parts}) r(p)
), books0 AS (
    SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM parts
    QUALIFY e < {entries}
), {", ".join(steps).replace(" AS (", " AS MATERIALIZED (")}, coded AS (
    SELECT vec_id, label, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY p) AS code, sum(d) AS error
    FROM near{rounds} GROUP BY vec_id, label
)
SELECT vec_id, code, error::BIGINT AS error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM books{rounds}) AS codebooks_sha256
FROM coded
"""


ORACLES["op11_centroid_clustering"] = _cluster_sql()
ORACLES["op12_vector_codes"] = _code_sql()

ORACLES["op13_sharding"] = """
WITH RECURSIVE steps(b, c, k) AS (
    SELECT b, b::BIGINT, 0 FROM range(256) r(b)
    UNION ALL
    SELECT b, CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8
), entries AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
coded AS (
    SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, list_transform(
        regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
        lambda p: (strpos('0123456789ABCDEF', p[1]) * 16 + strpos('0123456789ABCDEF', p[2]) - 17)::BIGINT) AS v
    FROM documents
), summed AS (
    SELECT doc_id, size, xor(list_reduce(v, lambda c, x: xor(list_extract(t, xor(c, x) % 256 + 1), c // 256),
        4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32
    FROM coded, entries
), placed AS (
    SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto,
        sum(size) OVER () AS whole
    FROM summed
), dealt AS (
    SELECT *, least(23, ((2 * upto - size) * 24) // (2 * whole)) AS s FROM placed
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, s::INTEGER AS shard,
    row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
    NULL::INTEGER AS grown_shard
FROM dealt
"""
