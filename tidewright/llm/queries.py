"""One query for each operator, over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, line_dedup, mixing, quality, sharding, simhash, toxicity

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return near.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), largest=True)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law "rows": shards' row counts differ by one at most. Copies of a text are rows like any other.

    Whole documents are dealt; the digest columns are made from the dealt rows.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size, crc = (F.octet_length(data) + 1).cast("long"), F.crc32(data)
    placed = sharding.shard_rows(_table(spark, sf_dir, "documents"), 16, keys=("doc_id", crc, size))
    return placed.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = quality.apply_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.copies(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def _digests(formatted: DataFrame) -> DataFrame:
    """Digest columns, read back from formatted conversations."""
    from hashlib import sha256

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                turns = chat.parse(text)
                loss = "".join(chat.unescape(text[a:b]) for a, b in spans)
                rows.append((len(turns), sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(text)))
            columns = zip(*rows) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is a message event; rows of a conversation follow each other by turn."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("seq"), "role", "text")
    own = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("seq"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    events = rows.unionByName(extra).withColumns({"kind": F.lit("message"), "turn": F.lit(None).cast("long")})
    return _digests(chat.format_conversations(events))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.severity(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "expected_severity", "grade", "toxic")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_exact_dedup, op3_sharding, op4_bpe, op5_quality_rules, op6_mixing, op7_quality_classifier, op8_line_dedup, op9_chat_format, op10_toxicity)
}

_WORDS = r"len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))"
_ESCAPED = "replace(replace(replace(replace(replace(replace(replace(replace({c}, '\\', '\\\\'), '<|', '<\\|'), '</s>', '<\\/s>'), '<s>', '<\\s>'), '<<SYS>>', '<\\<SYS>>'), '<</SYS>>', '<\\</SYS>>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]')"

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op6_mixing": rf"""
        WITH sized AS (
          SELECT doc_id, source, coalesce({_WORDS}, 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '~') || '/7') AS h FROM documents
        ), totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
        ), weighted AS (
          SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM totals
        ), run AS (
          SELECT *, sum(source_size) OVER ()::BIGINT AS all_size,
            coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_size,
            sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open_w
          FROM weighted
        ), levels AS (SELECT *, (1.5::DOUBLE * all_size - 2.0::DOUBLE * full_size) / open_w AS level FROM run
        ), settled AS (SELECT arg_max(level, open_w) AS settled FROM levels WHERE level * w <= 2.0::DOUBLE * source_size
        ), targets AS (
          SELECT source, source_size, coalesce(least(settled * w, 2.0::DOUBLE * source_size), 2.0::DOUBLE * source_size) AS target FROM levels, settled
        ), ranked AS (
          SELECT s.*, t.source_size, t.target, row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.h, s.doc_id) AS place,
            ('0x' || substr(md5(coalesce(s.source, '~') || '/offset/7'), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS off,
            CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate
          FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target, ((floor(off + place * rate) - floor(off + (place - 1) * rate)) * size)::BIGINT AS taken FROM ranked""",
    "op8_line_dedup": """
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {'id': doc_id, 'text': text} AS document, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), parts AS (SELECT r, doc_id, document, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs
        ), keyed AS (
          SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM parts
        ), gone AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT document) >= 10
        ), marked AS (SELECT k.*, g.key IS NOT NULL AS drop_it FROM keyed k LEFT JOIN gone g ON k.key = g.key)
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (drop_it) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT drop_it), '')) AS kept_sha256
        FROM marked GROUP BY r""",
    "op9_chat_format": f"""
        WITH rows AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        )
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
          coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
          sum({len(chat.TURN + chat.SAYS + chat.END)} + length({_ESCAPED.format(c="role")}) + length({_ESCAPED.format(c="text")}))::BIGINT AS formatted_chars
        FROM rows GROUP BY conv_id""",
}
