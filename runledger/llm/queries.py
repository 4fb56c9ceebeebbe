"""The operators' registered queries and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontam import DECONTAM_SQL
from .linechunks import LINES_SQL
from .resample import RESAMPLE_SQL
from .sourcemix import MIX_SQL

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_pack")
def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens; one row per piece."""
    from .packing import pack
    return pack(table(spark, sf_dir, "documents"))


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    from .simhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


@query("op2_shard")
def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 24 and its slot there, in shuffled order."""
    from .sharding import row_bytes, shard
    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select(
        "row.doc_id", row_bytes("row.text").alias("size"),
        F.crc32(F.coalesce("row.text", F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    replace(replace(replace(text, '\', '\\'), '</turn>', '\</turn>'), '### ', '\### ') AS said,
    replace(replace(replace(replace(role, '\', '\\'), '</turn>', '\</turn>'), '### ', '\### '), ':', '\:') AS head
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(said) + 9 + CASE WHEN before IS NOT DISTINCT FROM role THEN 0 ELSE 6 + length(head) END) AS BIGINT)
    AS formatted_chars
FROM o GROUP BY conv_id
"""


@query("op7_chat", CHAT_SQL)
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one full of control strings, formatted and read back."""
    from .chat import format_segments, read_segments
    hard = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(
        [(-7, 0, "user", hard), (-7, 1, "assistant", hard)], turns.schema))
    back = read_segments(format_segments(turns)).select(
        "conv_id", "segment", "chars", F.size("turns").cast("long").alias("n"),
        F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))).alias("said"),
        F.concat_ws("", "loss").alias("lost"))
    whole = back.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("segment", "said", "lost"))).alias("parts"))
    lost = F.concat_ws("", "parts.lost")
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.concat_ws("", "parts.said"), 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"), F.sha2(lost, 256).alias("loss_sha256"), "formatted_chars")


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    from .toxicity import classify
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_line_chunks", LINES_SQL)
def op6_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that occur earlier."""
    from .linechunks import dedup_lines
    return dedup_lines(table(spark, sf_dir, "documents")).select("row.doc_id", "text", "removed_passages", "removed_words")


@query("op4_decontaminate", DECONTAM_SQL)
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and how much of it."""
    from .decontam import contaminated
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("digest")


@query("op3_vector_dedup")
def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and keeper of every embedding."""
    from .vectors import near_duplicates
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def stand_in_edits(docs: DataFrame) -> DataFrame:
    """Up to three edits of each document: a stretch replaced by another of its text."""
    return docs.filter("text IS NOT NULL").select("doc_id", F.explode(F.expr("""
        transform(filter(sequence(0, 2), k -> k < pmod(xxhash64(doc_id), 4)), k -> struct(
          cast(pmod(xxhash64(doc_id, k, 'start'), length(text) + 1) AS long) AS start,
          cast(pmod(xxhash64(doc_id, k, 'length'), 30) AS long) AS length,
          substr(text, cast(pmod(xxhash64(doc_id, k, 'from'), length(text) + 1) AS int) + 1,
                 cast(pmod(xxhash64(doc_id, k, 'many'), 40) AS int)) AS insert))""")).alias("e")).select("doc_id", "e.*")


@query("op8_edit_counts")
def op8_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, before and after a table of edits."""
    from .common import store
    from .editcount import build, recount
    docs = table(spark, sf_dir, "documents")
    return recount(docs, store(build(docs), "trees"), stand_in_edits(docs)).drop("chars", "tokens")


@query("op10_lm_score")
def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a model of those not held out."""
    from .mixing import held_out, score
    scored = score(table(spark, sf_dir, "documents"), ~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), *scored.columns[1:])


@query("op11_source_mix", MIX_SQL)
def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a mix of the sources by weight takes."""
    from .sourcemix import plan
    return plan(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("row.doc_id", "size", "source_size", "target", "taken")


@query("op12_resample", RESAMPLE_SQL)
def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document in a draw towards the benchmark's words."""
    from .resample import draw
    return draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


@query("op13_whiten")
def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 whitened components of every embedding."""
    from .whitening import whiten
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
