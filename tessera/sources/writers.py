"""Writers: addressable shards, document-bounded shards, merges with coverage proof, retries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_SHARD = 10_000
#: Consecutive ids that one writer takes.
WRITER_IDS = 100_000


def addressed(rows: DataFrame, by: list[str], order: str, per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """Adds shard and line_index within each ``by`` group in the order of an integer column, so that a row can be named by its address.

    Rows are numbered inside blocks of WRITER_IDS consecutive values, on from the blocks before, so a group of any size is spread.
    """
    r = rows.withColumn("_block", F.expr(f"`{order}` div {WRITER_IDS}"))
    sums = r.groupBy(*by, "_block").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*by, "_block", F.coalesce(before, F.lit(0)).alias("_offset"))
    n = F.row_number().over(Window.partitionBy(*by, "_block").orderBy(order)) - 1
    placed = r.withColumn("_n", n).join(offsets, [*by, "_block"]).withColumn("_n", F.col("_n") + F.col("_offset"))
    return placed.withColumn("shard", F.floor(F.col("_n") / per_shard)).withColumn("line_index", (F.col("_n") % per_shard).cast("long")).drop("_n", "_offset", "_block")


def write_shards(rows: DataFrame, path: str, by: list[str], mode: str = "errorifexists") -> None:
    """One folder per group; an existing target is never replaced unless asked for."""
    rows.write.mode(mode).partitionBy(*by).option("maxRecordsPerFile", ROWS_PER_SHARD).json(path)


def document_shards(rows: DataFrame, by: list[str], order: str, size: str, capacity: int) -> DataFrame:
    """Adds block and shard: documents are packed in order, and a shard closes before one would take it over ``capacity``.

    No document is split; one that is larger than the capacity has a shard of its own. Each block of WRITER_IDS
    consecutive values of ``order`` (an integer) is a writer of its own, so a ``by`` group of any size is spread.
    """
    placed = rows.withColumn("block", F.expr(f"`{order}` div {WRITER_IDS}"))
    schema = T.StructType([*placed.schema.fields, T.StructField("shard", T.LongType())])

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        shard, fill, out = 0, 0, []
        for i, n in enumerate(group[size].fillna(0).tolist()):
            if i and fill + n > capacity:
                shard, fill = shard + 1, 0
            fill += n
            out.append(shard)
        return group.assign(shard=out)

    return placed.groupBy(*by, "block").applyInPandas(pack, schema)


def coverage(batches: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Issues (keys, code) of merged batches: repeated, missing or unexpected."""
    n = batches.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    j = n.join(expected.select(*keys).distinct().withColumn("_e", F.lit(True)), keys, "full_outer")
    code = F.when(F.col("_n") > 1, "duplicate").when(F.col("_n").isNull(), "missing").when(F.col("_e").isNull(), "unexpected")
    return j.withColumn("code", code).filter("code IS NOT NULL").select(*keys, "code")


def retry_only(work: DataFrame, failures: DataFrame, keys: list[str]) -> DataFrame:
    """The work items that a failure manifest names."""
    return work.join(failures.select(*keys).distinct(), keys, "left_semi")
