"""The queries op1 to op13 and the pipeline over the table documents, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, with_scratch
from .conversations import damaged, repair_conversations
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_components
from .kneser_ney import kn_quality
from .lm_scoring import lm_scores
from .merkle import folded, leaf, merkle_proofs, proof_digest, tampered
from .mixing import mix_plan
from .oracles import OP11, OP12
from .packing import best_fit_packing
from .pii import find_pii
from .quality_rules import quality_rules
from .sharding import shard_by_splitters
from .simhash import simhash_components
from .token_output import read_token_files, write_token_files


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_splitters(_documents(spark, sf_dir))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_documents(spark, sf_dir), n=3, percent=90)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    return best_fit_packing(_documents(spark, sf_dir), tokenizer_path or public_vocabulary())


def op4_simple8b(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    files = scratch_path(spark, "token-files")
    write_token_files(_documents(spark, sf_dir), files, tokenizer_path or public_vocabulary())
    return read_token_files(spark, files)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    result = quality_rules(_documents(spark, sf_dir), labels)
    return result.drop("score")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_documents(spark, sf_dir))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn_quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """visits: epoch:shard:words of each draw; taken is the sum of their words."""
    visits = F.array_join(F.transform("visits", lambda v: F.concat_ws(":", v["epoch"], v["shard"], v["words"])), ",")
    return mix_plan(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", visits.alias("visits"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = leaf(*[tampered() if c == "text" else F.col(c) for c in columns])
    rows = merkle_proofs(_documents(spark, sf_dir), columns, carried={"changed": changed})
    rows = rows.withColumns({"proof_sha256": proof_digest(F.col("proof")), "folded_root": folded(F.col("changed"), F.col("proof"))})
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """By name; results have a method release() that deletes their scratch tables."""
    named = {
        "op1_sharding": op1_sharding,
        "op2_ngram_jaccard": op2_ngram_jaccard,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_simple8b": op4_simple8b,
        "op5_quality_rules": op5_quality_rules,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_lm_scoring": op7_lm_scoring,
        "op8_kneser_ney": op8_kneser_ney,
        "op9_pii": op9_pii,
        "op10_mixing": op10_mixing,
        "op11_conversations": op11_conversations,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_simhash": op13_simhash,
    }
    return {name: with_scratch(query) for name, query in named.items()}


OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), w AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": OP6_SQL, "op11_conversations": OP11, "op12_merkle_manifest": OP12}
