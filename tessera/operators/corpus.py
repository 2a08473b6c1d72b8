"""Corpus operators: flags, block lists, first-wins dedup, splits, budgets, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import answer_cue, norm


def quality_flags(text: Column, min_words: int = 16) -> Column:
    """Names of all flags that a text raises, in a fixed order."""
    t = F.coalesce(text, F.lit(""))
    blank = norm(t) == ""
    words = F.when(blank, 0).otherwise(F.size(F.split(norm(t), " ")))
    return F.array_compact(F.array(
        F.when(blank, F.lit("empty_message")), F.when(t.rlike("<\\|[a-z_]+\\|>|\\[/?INST\\]|</s>"), F.lit("embedded_chat_control")),
        F.when(answer_cue(t), F.lit("answer_cue")), F.when(t.rlike("<mol>"), F.lit("unresolved_placeholder")), F.when(words < min_words, F.lit("fewer_than_min_words")),
    ))


def blocked_reasons(rows: DataFrame, keys: list[tuple[str, str, DataFrame]], reasons: str = "reasons") -> DataFrame:
    """Adds the names of the block lists that a row's keys meet.

    keys: (reason, column of rows, one-column DataFrame of blocked values); an array column meets a list by
    any element. Every list is made distinct and joined by hash; Spark broadcasts those that are small.
    """
    out = rows.withColumn("_row", F.monotonically_increasing_id()) if any(dict(rows.dtypes)[c].startswith("array") for _, c, _ in keys) else rows
    for i, (reason, column, blocked) in enumerate(keys):
        flag, value = f"_blocked{i}", blocked.columns[0]
        values = blocked.select(F.col(value).alias(column if not dict(rows.dtypes)[column].startswith("array") else "_item")).distinct().withColumn(flag, F.lit(reason))
        if dict(rows.dtypes)[column].startswith("array"):
            hit = out.select("_row", F.explode(column).alias("_item")).join(values, "_item", "left_semi").select("_row").distinct().withColumn(flag, F.lit(reason))
            out = out.join(hit, "_row", "left")
        else:
            out = out.join(values, column, "left")
    flags = [f"_blocked{i}" for i in range(len(keys))]
    return out.withColumn(reasons, F.array_compact(F.array(*flags))).drop("_row", *flags)


def first_wins(rows: DataFrame, key: str, order: list[str], id_col: str, namespace: list[str] = ()) -> DataFrame:
    """Adds ``kept`` and ``duplicate_of`` (the id that came first) to rows with equal ``key``.

    A key's first row comes from an aggregate with partial sums, so a hot key isn't gathered in one task.
    """
    first = rows.groupBy(*namespace, key).agg(F.min(F.struct(*order, F.col(id_col).alias("_id"))).alias("_first"))
    joined = rows.join(first, [*namespace, key])
    own = F.col(id_col) == F.col("_first._id")
    return joined.withColumn("kept", own).withColumn("duplicate_of", F.when(~own, F.col("_first._id"))).drop("_first")


def hash_split(group: Column, seed: int, share: float) -> Column:
    """``validation`` for a share of the groups, by a digest that other engines compute as well."""
    part = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), group.cast("string")), 256), F.lit(12)), 16, 10).cast("double") / float(16**12)
    return F.when(part < share, F.lit("validation")).otherwise(F.lit("train"))


def seeded_order(seed: str, *ids: Column) -> Column:
    """A reproducible random order: a digest of seed and ids."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in ids]), 256)


#: Leading hex digits of an order digest that make a run.
RUN_DIGITS = 3


def running_before(rows: DataFrame, groups: list[str], digest: str, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of a group whose ``digest`` comes before.

    Rows with the same leading digits form a run, as digests are even; sums are taken inside runs and over the runs'
    sums, so a group of any share of the rows is spread over 16^RUN_DIGITS tasks.
    """
    r = rows.withColumn("_run", F.left(digest, F.lit(RUN_DIGITS)))
    w = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = r.groupBy(*groups, "_run").agg(F.sum(value).alias("_n"))
    offsets = sums.select(*groups, "_run", F.coalesce(F.sum("_n").over(w(groups, "_run")), F.lit(0)).alias("_offset"))
    inner = r.withColumn("_inner", F.coalesce(F.sum(value).over(w([*groups, "_run"], digest)), F.lit(0)))
    return inner.join(offsets, [*groups, "_run"]).withColumn(out, F.col("_inner") + F.col("_offset")).drop("_run", "_inner", "_offset")


def budget_selection(rows: DataFrame, strata: list[str], digest: Column, tokens: str, target: Column) -> DataFrame:
    """Rows of each stratum in the order of a digest while the tokens before them stay under the target; the last may overshoot."""
    placed = running_before(rows.withColumn("_digest", digest), strata, "_digest", tokens, "_before")
    return placed.filter(F.col("_before") < target).drop("_before", "_digest")


def exact_quantile(rows: DataFrame, group: str, value: str, p: float, low: float, high: float, parts: int = 4096) -> DataFrame:
    """(group, quantile): the exact quantile, by linear interpolation, of values in [low, high].

    Values are counted by parts of the range first; only the parts that hold the two ranks asked for are put in order.
    """
    v = rows.filter(F.col(value).between(low, high)).select(group, F.col(value).alias("_v"), F.least(F.floor((F.col(value) - low) / (high - low) * parts), F.lit(parts - 1)).alias("_part"))
    n = v.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    upto = n.withColumn("_upto", F.sum("_n").over(Window.partitionBy(group).orderBy("_part"))).withColumn("_all", F.sum("_n").over(Window.partitionBy(group)))
    rank = (F.col("_all") - 1) * F.lit(p)
    first = F.col("_upto") - F.col("_n")
    wanted = upto.withColumn("_rank", rank).filter((first <= F.ceil("_rank")) & (F.col("_upto") > F.floor("_rank"))).select(group, "_part", "_rank", first.alias("_first"))
    placed = v.join(wanted, [group, "_part"]).withColumn("_at", F.row_number().over(Window.partitionBy(group, "_part").orderBy("_v")) - 1 + F.col("_first"))
    at = lambda r: F.max(F.when(F.col("_at") == r, F.col("_v")))
    ends = placed.groupBy(group).agg(at(F.floor("_rank")).alias("_lo"), at(F.ceil("_rank")).alias("_hi"), F.max("_rank").alias("_rank"))
    return ends.select(group, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_rank") - F.floor("_rank"))).alias("quantile"))


def first_per_group(rows: DataFrame, groups: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group with their rank; Spark cuts the groups down before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col(rank) <= n)


def round_robin(rows: DataFrame, strata: list[str], order: list[Column]) -> DataFrame:
    """Adds ``turn``: the row's place within its stratum, so that ordering by it interleaves strata."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(*strata).orderBy(*order)))


def conservation(rows: DataFrame, by: str, kept: Column) -> DataFrame:
    """Per value of ``by``: rows in, kept and excluded, and whether they add up."""
    t = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_in"), F.count_if(kept).cast("long").alias("n_kept"), F.count_if(~kept).cast("long").alias("n_excluded"))
    return t.withColumn("balanced", F.col("n_in") == F.col("n_kept") + F.col("n_excluded"))
