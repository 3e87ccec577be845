"""The operators as registered queries, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm import (
    bpe, chunk_dedup, embedding_join, exact_dedup, langid, minhash, mixing, prefix_trie, repeats, secrets, spelling, topk, warc,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with SQL for DuckDB that returns the same rows."""

    def register(build: Query) -> Query:
        QUERIES[build.__name__] = build
        if sql:
            ORACLE[build.__name__] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def byte_codec(spark: SparkSession) -> bpe.Codec:
    import public_tokenizers

    return bpe.Codec(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Token counts and digests of ids and decoded bytes, for every row of ``docs``."""
    return byte_codec(docs.sparkSession).round_trip(docs, "doc_id", "text").select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_digests(table(spark, folder, "documents"))


@query("""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    g AS (SELECT doc_id, text, max(doc_id) OVER (PARTITION BY text) AS keep_id,
                 count(*) OVER (PARTITION BY text) AS group_size,
                 row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) AS place FROM d)
    SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(text) AS text_sha256 FROM g
""")
def op9_extendible_hash(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))[0]


@query()
def op2_entropy_balancing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select(
        F.col("row.doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


@query()
def op4_ftrl_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.train(docs)
    found = docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), langid.identify(model, spark, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


@query("""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    f AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
    g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM f)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
    FROM g
""")
def op5_warc_normaliser(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.archive_pages(table(spark, folder, "pages"))
    # What is returned comes from the records that were read back.
    own = F.col("payload").isNotNull()
    return records.select(
        F.col("page").cast("long").alias("page_id"),
        F.when(own, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(own, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


@query()
def op8_epsilon_grid_order(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_join.embedding_links(table(spark, folder, "embeddings"))


@query()
def op6_probminhash(spark: SparkSession, folder: str) -> DataFrame:
    classes = minhash.near_dedup(table(spark, folder, "documents"))
    return classes.select("doc_id", "class_id", "kept")


@query()
def op3_gear_chunks(spark: SparkSession, folder: str) -> DataFrame:
    cut = chunk_dedup.chunk_dedup(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op10_run_length_index(spark: SparkSession, folder: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op7_secret_forest(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    found = secrets.find_candidates(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    judged = secrets.judge(found, secrets.rule_labels(found))
    return judged.select(
        F.col("id").alias("doc_id"), "lo", "hi", F.sha2("candidate", 256).alias("candidate_sha256"), F.round("score", 6).alias("score"), "is_secret"
    )


# crc32, a byte at a time: the register after each of the 256 bytes, then a fold over the bytes of a text.
_CRC_TABLE = """crc AS (SELECT list(v ORDER BY i) AS steps FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM range(256) t(i)))"""


def _crc32(text: str, steps: str = "(SELECT steps FROM crc)") -> str:
    """SQL for the unsigned crc32 of a text's bytes; needs ``_CRC_TABLE``."""
    byte = f"(instr('0123456789ABCDEF', substr(hex({text}), 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hex({text}), 2 * i + 2, 1)) - 1"
    bytes_ = f"list_transform(range(strlen({text})), lambda i: CAST({byte} AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(c >> 8, {steps}[(xor(c, b) & 255) + 1])), 4294967295)"


@query(f"""
    WITH RECURSIVE {_CRC_TABLE},
    runs AS (
        SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(r, '{spelling.CAPITALS}', '{spelling.SMALL}') AS run, count(*) AS n
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS r FROM documents) GROUP BY ALL),
    hashed AS (SELECT run, n, {_crc32("(id || ':' || run)", "steps")} AS h FROM runs, crc),
    spelled AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
    words AS (SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    cuts AS (SELECT DISTINCT word, n, i, substr(word, 1, i) AS head, substr(word, i + 2) AS tail FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
    near AS (
        SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
        UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.head || c.tail
        UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.head || c.tail),
    best AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word),
    forms AS (
        SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 2 * w.n THEN b.top END AS form_n,
               CASE WHEN b.top >= 2 * w.n THEN (SELECT min(x.other) FROM near x WHERE x.word = w.word AND x.other_n = b.top) END AS form
        FROM words w LEFT JOIN best b ON b.word = w.word),
    walk AS (SELECT word, word AS at FROM forms UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.at WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, k.at AS root, f.n, f.n_near, f.form_n
    FROM forms f JOIN walk k ON k.word = f.word JOIN forms e ON e.word = k.at AND e.form IS NULL
""")
def op11_trie_node_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))


@query("""
    WITH v AS (
        SELECT row_number() OVER () AS rk, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS w
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT q.rk, q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, least(len(q.w), len(c.w)) + 1), lambda i: q.w[i] * c.w[i])), 0)::BIGINT AS score
        FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.rk <> c.rk),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY rk ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""")
def op12_term_at_a_time(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search_vectors(table(spark, folder, "embeddings"), 20, 20)


@query(f"""
    WITH {_CRC_TABLE},
    turns AS (
        SELECT conv_id AS c, turn, sha256(strlen(r)::VARCHAR || ':' || r || x) AS key, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS words
        FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, key) - 1 AS pos FROM turns),
    ids AS (SELECT c, {_crc32("(c::VARCHAR)", "steps")} % 4 AS h FROM (SELECT DISTINCT c FROM turns), crc),
    built AS (
        SELECT i.c, 0 AS part, p.pos, p.key, p.words FROM ids i JOIN placed p ON p.c = i.c - i.c % 20 AND p.pos < i.h
        UNION ALL SELECT i.c, 1, p.pos, p.key, p.words FROM ids i JOIN placed p ON p.c = i.c AND p.pos >= i.h),
    seqs AS (SELECT i.c, coalesce(list(b.key ORDER BY b.part, b.pos) FILTER (b.key IS NOT NULL), []) AS seq FROM ids i LEFT JOIN built b ON b.c = i.c GROUP BY i.c),
    steps AS (SELECT c, seq, unnest(range(len(seq) + 1)) AS depth FROM seqs),
    nodes AS (SELECT seq[1:depth] AS path, depth, min(c) AS conv_id, count(*) AS n_convs FROM steps GROUP BY ALL),
    children AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
    lengths AS (SELECT DISTINCT key, words FROM turns),
    own AS (
        SELECT n.*, coalesce(k.n, 0) AS n_children, coalesce((n.n_convs - 1) * l.words, 0) AS saved
        FROM nodes n LEFT JOIN children k ON k.path = n.path LEFT JOIN lengths l ON l.key = n.path[n.depth]),
    subtree AS (
        SELECT path[1:d] AS path, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
        FROM (SELECT path, n_children, saved, unnest(range(depth + 1)) AS d FROM own) GROUP BY ALL),
    ends AS (SELECT seq AS path, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS hash FROM seqs GROUP BY ALL)
    SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves, s.saved_tokens, coalesce(e.hash, sha256('')) AS ends_sha256
    FROM own o JOIN subtree s ON s.path = o.path LEFT JOIN ends e ON e.path = o.path
    LEFT JOIN nodes p ON o.depth > 0 AND p.path = o.path[1:o.depth - 1]
""")
def op13_ternary_search_trees(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, folder, "conversations"))
