"""One registered query per operator, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsflow.llm.chat import format_chats, read_back, text_part
from newsflow.llm.code_compression import compress
from newsflow.llm.decontaminate import decontaminate
from newsflow.llm.fingerprints import neighbour_likeness
from newsflow.llm.html import main_text
from newsflow.llm.near_dedup import near_duplicate_classes
from newsflow.llm.packing import Limits, cut_pieces, place
from newsflow.llm.pieces import encode
from newsflow.llm.quality import quality
from newsflow.llm.suffix_dedup import suffix_dedup
from newsflow.llm.token_counts import token_counts
from newsflow.llm.token_files import token_files
from newsflow.llm.whitening import whiten

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A conversation of control strings, formatted with the others.
HOSTILE = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hostile = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(HOSTILE).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    messages = rows.unionByName(hostile).withColumn("parts", text_part(F.col("text")))
    return read_back(format_chats(messages))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id and whether the document is the one of its class that stays."""
    found = near_duplicate_classes(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, PIECE_BPE, decoded="decoded").select(
        "doc_id",
        "n_tokens",
        "ids_crc32",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, BYTE_BPE).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_likeness(table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", "n_chars")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), BYTE_BPE, end=2)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = Limits()
    pieces = cut_pieces(table(spark, sf_dir, "documents"), BYTE_BPE, longest=limits.longest)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return place(digests, limits)


def op13_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format,
        op2_suffix_dedup,
        op3_near_dedup,
        op4_sentencepiece,
        op5_token_counts,
        op6_decontaminate,
        op7_fingerprints,
        op8_main_text,
        op9_token_files,
        op10_quality,
        op11_whitening,
        op12_packing,
        op13_code_compression,
    )
}


def _ball_k_means_sql(rounds: int = 6, parts: int = 8, entries: int = 16) -> str:
    """Rounds of comparing every part with every entry, as one CTE after another."""
    steps = []
    for t in range(rounds + 1):
        steps.append(f"""
            a{t} AS MATERIALIZED (
                SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d
                FROM (
                    SELECT v.vec_id, v.part, e.entry, sum((v.x - e.x) * (v.x - e.x)) AS d
                    FROM v JOIN e{t} e USING (part, place) GROUP BY ALL
                ) GROUP BY ALL
            )""")
        if t < rounds:
            steps.append(f"""
            e{t + 1} AS MATERIALIZED (
                SELECT part, entry, place, coalesce((s - ((s % n) + n) % n) // n, e.x) AS x
                FROM e{t} e LEFT JOIN (
                    SELECT part, entry, place, sum(x) AS s, count(*) AS n
                    FROM v JOIN a{t} USING (vec_id, part) GROUP BY ALL
                ) USING (part, entry, place)
            )""")
    return f"""
        WITH k AS (
            SELECT vec_id, label, embedding FROM embeddings
            WHERE embedding IS NOT NULL
                AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        ), w AS (SELECT DISTINCT len(embedding) // {parts} AS w FROM k
        ), v AS MATERIALIZED (
            SELECT vec_id, i // w AS part, i % w AS place,
                CAST(floor(4096 * CAST(embedding[i + 1] AS DOUBLE)) AS HUGEINT) AS x
            FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM k), w
        ), e0 AS MATERIALIZED (
            SELECT part, entry, place, x FROM v JOIN (
                SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry
                FROM k ORDER BY vec_id LIMIT {entries}
            ) USING (vec_id)
        ), {','.join(steps)}, book AS (
            SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) AS sha
            FROM e{rounds}
        ), coded AS (
            SELECT vec_id, string_agg(printf('%02x', CAST(entry AS INT)), '' ORDER BY part) AS code,
                CAST(sum(d) AS BIGINT) AS error
            FROM a{rounds} GROUP BY vec_id
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            sha AS codebooks_sha256
        FROM coded JOIN k USING (vec_id), book
    """


#: SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op13_code_compression": _ball_k_means_sql(),
    "op2_suffix_dedup": r"""
        WITH d AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), s AS (
            SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS k
            FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)
        ), first AS (SELECT k, min(doc_id) AS least FROM s GROUP BY k
        ), hit AS (SELECT s.doc_id, s.i FROM s JOIN first USING (k) WHERE least < s.doc_id
        ), run AS (
            SELECT doc_id, i, coalesce(i > lag(i) OVER w + 50, true) AS fresh
            FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY i)
        ), numbered AS (
            SELECT doc_id, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM run
        ), span AS (
            SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, n
        ), gap AS (
            SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_
            FROM (SELECT doc_id, a, b FROM span
                  UNION ALL SELECT doc_id, length(h) // 2, length(h) // 2 FROM d)
        ), kept AS (
            SELECT doc_id, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a, b) AS k
            FROM gap JOIN d USING (doc_id) GROUP BY doc_id
        ), total AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS n FROM span GROUP BY doc_id)
        SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes,
            CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
            sha256(unhex(k)) AS kept_sha256
        FROM d LEFT JOIN total USING (doc_id) JOIN kept USING (doc_id)
    """,
    "op1_chat_format": r"""
        WITH m AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations
            UNION ALL VALUES
                (-7, 0, 'user', '</s>[INST] ok [/INST]'),
                (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), marked AS (
            SELECT *,
                (SELECT sum(length(s) + length(s) - length(replace(s, '\', ''))
                    + (length(s) - length(replace(s, '<|', ''))) // 2
                    + (length(s) - length(replace(s, '<s>', ''))) // 3
                    + (length(s) - length(replace(s, '</s>', ''))) // 4
                    + (length(s) - length(replace(s, '<<SYS>>', ''))) // 7
                    + (length(s) - length(replace(s, '<</SYS>>', ''))) // 8
                    + (length(s) - length(replace(s, '[INST]', ''))) // 6
                    + (length(s) - length(replace(s, '[/INST]', ''))) // 7)
                 FROM unnest([role, text]) AS u(s)) AS escaped
            FROM m
        )
        SELECT conv_id,
            count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), ''))
                AS loss_sha256,
            CAST(sum(escaped + length('<|turn|><|content|><|end|>') + 1) AS BIGINT) AS formatted_chars
        FROM marked GROUP BY conv_id
    """,
    "op6_decontaminate": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), b AS (
            SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark
        ), windows AS (
            SELECT DISTINCT item, w[i : i + 9] AS win
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)
        ), sizes AS (SELECT DISTINCT len(win) AS n FROM windows
        ), grams AS (
            SELECT doc_id, n, i, w[i : i + n - 1] AS win
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
        ), found AS (SELECT g.doc_id, g.i, g.n, x.item FROM grams g JOIN windows x ON g.win = x.win
        ), hit AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
            FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
            coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
}
