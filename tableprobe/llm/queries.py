"""The registered text queries: each applies one operator to its whole table, with production settings."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprobe.llm import bpe, chat_format, quality
from tableprobe.llm.embedding_dedup import embedding_groups
from tableprobe.llm.exact_dedup import exact_dedup
from tableprobe.llm.language_id import learn_profiles, predict_language
from tableprobe.llm.line_dedup import line_dedup
from tableprobe.llm.packing import pack_documents
from tableprobe.llm.secret_scan import scan_secrets, span_text
from tableprobe.llm.simhash import simhash_groups
from tableprobe.llm.suffix_dedup import suffix_dedup
from tableprobe.llm.turn_repair import repair_report, repair_turns
from tableprobe.llm.whitening import whiten
from tableprobe.plans.tables import table

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(WORD_BPE)
    encoded = bpe.encode_texts(table(spark, sf_dir, "documents"), path)
    return bpe.decode_ids(encoded, path).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines",
        F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"), words=3, distance=3).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")

    base = F.filter("secrets", lambda s: s["kind"] != "literal")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("secrets")).alias("spans"))


def fold(column: str, folds: int) -> Column:
    """The checksum of the key as text, modulo ``folds``; 0 for a null key."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds, F.lit(0))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    learned = F.col("doc_id").isNotNull() & (fold("doc_id", 5) != 0)
    profiles = learn_profiles(documents, learned)
    return predict_language(documents.select("doc_id", "text"), profiles).select(
        "doc_id", (~learned).alias("held_out"), "lang_pred", "score")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(documents, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return quality.score(documents, model).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return suffix_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened")).select(
        "vec_id", (F.col("pos") + 1).alias("component"), "n", "deviation", F.col("col").alias("whitened"),
        F.get("explained", F.col("pos")).alias("explained"), "identity_error")


def damaged(conversations: DataFrame) -> DataFrame:
    """The conversations with rows dropped, emptied, cut, repeated and given to the user, by a checksum of their keys."""
    def filled(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    return conversations.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(filled("role")).alias("role"), text.alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    report = repair_report(repair_turns(damaged(conversations))).withColumnRenamed("conv_id", "_conv_id")
    every = conversations.select("conv_id").distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(report, F.col("conv_id").eqNullSafe(F.col("_conv_id")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = chat_format.format_chats(chat_format.with_example(table(spark, sf_dir, "conversations")))
    read = chats.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("turns"),
                        chat_format.learned_text(F.col("segments")).alias("learned"), "formatted")
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_simhash": op4_simhash,
    "op5_secrets": op5_secrets,
    "op6_language": op6_language,
    "op7_embeddings": op7_embeddings,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_whitening": op11_whitening,
    "op12_turns": op12_turns,
    "op13_chat": op13_chat,
}

LINE_DEDUP_SQL = """
    all_lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM {source}),
    line_windows AS (
        SELECT doc_id, pos, parts[pos] || chr(10) || parts[pos + 1] || chr(10) || parts[pos + 2] AS body
        FROM (SELECT doc_id, parts, unnest(range(1, len(parts) - 1)) AS pos FROM all_lines)),
    later AS (
        SELECT doc_id, pos FROM line_windows QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) > 1),
    covered AS (
        SELECT doc_id, line, line - dense_rank() OVER (PARTITION BY doc_id ORDER BY line) AS run
        FROM (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS line FROM later)),
    counted AS (
        SELECT doc_id, count(*) AS n_removed, count(DISTINCT run) AS n_spans, list(line) AS gone
        FROM covered GROUP BY doc_id),
    thinned AS (
        SELECT a.doc_id, coalesce(len(parts), 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
               coalesce(n_spans, 0) AS n_spans,
               CASE WHEN gone IS NULL THEN text ELSE array_to_string(
                   [parts[i] FOR i IN range(1, len(parts) + 1) IF NOT list_contains(gone, i)], chr(10)) END AS text
        FROM all_lines a LEFT JOIN counted c ON a.doc_id = c.doc_id)"""

ORACLES: dict[str, str] = {
    "op13_chat": r"""
        WITH every AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        marked AS (
            SELECT *, role IS DISTINCT FROM lag(role) OVER (
                PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS opens FROM every),
        measured AS (
            SELECT *, length(text) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*(/?INST|/?ROLE|NEXT)\]')) + CASE
                WHEN NOT opens THEN 6 WHEN role = 'user' THEN 13 WHEN role = 'assistant' THEN 7
                ELSE 17 + length(role) + len(regexp_extract_all(role, '<\\*/?s>|\[\\*(/?INST|/?ROLE|NEXT)\]'))
                END AS size
            FROM marked)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text))
                   AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                   FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(size)::BIGINT AS formatted_chars
        FROM measured GROUP BY conv_id""",
    "op3_line_dedup": f"""
        WITH {LINE_DEDUP_SQL.format(source="documents")}
        SELECT doc_id, n_lines, n_removed, n_spans, sha256(coalesce(text, '')) AS kept_sha256 FROM thinned""",
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
