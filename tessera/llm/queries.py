"""The registered queries of the training-data operators and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import table


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import assign_shards

    placed = assign_shards(table(spark, sf_dir, "documents"), n_shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality_model import score_documents

    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=False)


def op4_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pii import pii_summary

    return pii_summary(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.chat_format import chain_of_turns, format_chats, read_back, unescaped

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    chats = format_chats(chain_of_turns(rows.unionByName(probe)))
    turns = read_back(F.col("formatted"))
    digest = F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    slices = F.transform("loss_spans", lambda x: F.substring(F.col("formatted"), (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")))
    loss = F.array_join(F.transform(slices, unescaped), "")
    return chats.select(
        F.col("tree").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "formatted", "loss_spans",
    )


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality_rules import BASE, RULES, judged

    q = F.col("_quality")
    base = F.size(F.array_intersect(q["failed"], F.array(*[F.lit(r[0]) for r in RULES[:BASE]]))) > 0
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *[q[f].alias(f) for f in fields], base.alias("base_failed"), q["kept"].alias("kept"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix

    mixed, _ = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def _op9_oracle() -> str:
    from tessera.llm.quality_rules import oracle

    return oracle()


QUERIES = {"op2_licenses": op2_licenses, "op3_repeats": op3_repeats, "op1_quality": op1_quality, "op4_leaks": op4_leaks, "op8_near_dup": op8_near_dup, "op10_mix": op10_mix, "op5_pii": op5_pii, "op7_chat": op7_chat, "op9_quality_rules": op9_quality_rules, "op6_shards": op6_shards}
ORACLES: dict[str, str] = {"op9_quality_rules": _op9_oracle()}
