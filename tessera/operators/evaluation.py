"""Evaluation of predictions and choice among candidates: plan following, log probabilities, balance, quotas, packing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.corpus import seeded_order

#: Targets that a prediction is compared with.
TARGETS = ("ground_truth", "clean_plan", "executed")


def followed(prediction: Column, truth: Column, executed: Column) -> Column:
    """The class of a prediction by which target it equals; null is no valid prediction."""
    is_truth, is_wrong = F.coalesce(prediction == truth, F.lit(False)), F.coalesce(prediction == executed, F.lit(False))
    return (
        F.when(prediction.isNull(), "invalid_output").when(is_truth & is_wrong, "ground_truth_and_executed")
        .when(is_truth, "ground_truth_only").when(is_wrong, "executed_only").otherwise("neither")
    )


def compare_predictions(rows: DataFrame, scopes: tuple[str, ...] = ("full", "primary")) -> DataFrame:
    """Adds, for each scope, ``<scope>_class`` and whether each target is met.

    rows hold a canonical key for each scope of the prediction and of every target: ``<scope>_prediction``,
    ``<scope>_ground_truth`` and so on.
    """
    out = rows
    for s in scopes:
        p = F.col(f"{s}_prediction")
        out = out.withColumn(f"{s}_class", followed(p, F.col(f"{s}_ground_truth"), F.col(f"{s}_executed")))
        for t in TARGETS:
            out = out.withColumn(f"{s}_is_{t}", F.coalesce(p == F.col(f"{s}_{t}"), F.lit(False)))
    return out


def following_summary(compared: DataFrame, expected: DataFrame, group: str, scopes: tuple[str, ...] = ("full", "primary")) -> DataFrame:
    """Per group of ``expected`` (group, n_expected): rows, valid ones, met targets, rates, and complete, partial or pending."""
    counts = [F.count_if(F.col(f"{s}_is_{t}")).alias(f"{s}_{t}") for s in scopes for t in TARGETS]
    per = compared.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(f"{scopes[0]}_class") != "invalid_output").alias("n_valid"), *counts)
    names = ["n", "n_valid", *(f"{s}_{t}" for s in scopes for t in TARGETS)]
    j = expected.join(per, group, "left").na.fill(0, names)
    rates = [(F.col(f"{s}_{t}") / F.nullif("n", F.lit(0))).alias(f"{s}_{t}_rate") for s in scopes for t in TARGETS]
    status = F.when(F.col("n") == 0, "pending").when(F.col("n") < F.col("n_expected"), "partial").otherwise("complete")
    return j.select(group, "n_expected", *names, *rates, status.alias("status"))


def answer_logprob(scores: Column, tokens: Column, start: Column, answer: Column) -> Column:
    """(sum, mean, n, issue) over the answer's tokens at ``start``; tokens that differ, scores that are missing or not finite are issues."""
    n = F.size(answer)
    part = F.slice(scores, (start + 1).cast("int"), n)
    bad = F.exists(part, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    issue = (
        F.when((F.size(scores) != F.size(tokens)) | scores.isNull(), "misaligned").when(F.slice(tokens, (start + 1).cast("int"), n) != answer, "tokens_differ")
        .when((F.size(part) < n) | bad, "score_missing")
    )
    total = F.aggregate(part, F.lit(0.0), lambda s, x: s + x)
    ok = issue.isNull() & (n > 0)
    return F.struct(F.when(ok, total).alias("sum"), F.when(ok, total / n).alias("mean"), n.alias("n"), issue.alias("issue"))


def contrasts(rows: DataFrame, pair: str, condition: str, wanted: list[tuple[str, str, str]]) -> DataFrame:
    """Per contrast (name, baseline, treatment): pairs, mean differences of ``sum`` and ``mean``, and pairs whose answers differ."""
    side = lambda c, p: rows.filter(F.col(condition) == c).select(pair, *[F.col(x).alias(f"{p}_{x}") for x in ("sum", "mean", "answer")])
    parts = []
    for name, baseline, treatment in wanted:
        j = side(baseline, "b").join(side(treatment, "t"), pair)
        same = F.col("b_answer") == F.col("t_answer")
        mean = lambda c: F.avg(F.when(same, F.col(f"t_{c}") - F.col(f"b_{c}")))
        parts.append(j.agg(F.lit(name).alias("contrast"), F.count_if(same).alias("n"), mean("sum").alias("delta_sum"), mean("mean").alias("delta_mean"), F.count_if(~same).alias("n_answers_differ")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def balanced(rows: DataFrame, record: str, bucket: str, order: list[Column], bucket_order: list[Column], most: int) -> DataFrame:
    """At most ``most`` candidates of each record, its buckets in turn; adds ``place``."""
    turn = F.row_number().over(Window.partitionBy(record, bucket).orderBy(*order))
    turned = rows.withColumn("_turn", turn).filter(F.col("_turn") <= most)  # no more can be taken from one bucket
    place = F.row_number().over(Window.partitionBy(record).orderBy("_turn", *bucket_order))
    return turned.withColumn("place", place).filter(F.col("place") <= most).drop("_turn")


#: The order in which families are asked for candidates, and who stands in for an empty one.
SCHEDULE = ("fragment", "fragment", "anchor", "combined")
FALLBACK = ("combined", "fragment", "anchor", "delete")


def family_quota(rows: DataFrame, record: str, family: str, candidate: str, most: int, schedule: tuple[str, ...] = SCHEDULE, fallback: tuple[str, ...] = FALLBACK) -> DataFrame:
    """(record, place, family, candidate): slots dealt by the schedule, empty families replaced in fallback order.

    Of each family at most ``most`` candidates are carried, the first in order, so a record's lists are bounded.
    """
    rank = F.row_number().over(Window.partitionBy(record, family).orderBy(candidate))
    few = rows.select(record, family, candidate).withColumn("_r", rank).filter(F.col("_r") <= most)
    lists = few.groupBy(record).agg(F.array_sort(F.collect_list(F.struct(F.col("_r").alias("r"), F.col(family).alias("f")))).alias("_l"))

    def deal(pairs) -> list[dict]:
        left: dict[str, int] = {}
        for x in pairs:
            left[x["f"]] = left.get(x["f"], 0) + 1
        used = dict.fromkeys(left, 0)
        out = []
        for i in range(most):
            name = next((n for n in (schedule[i % len(schedule)], *fallback) if used.get(n, 0) < left.get(n, 0)), None)
            if name is None:
                break
            used[name] += 1
            out.append({"place": i + 1, "family": name, "rank": used[name]})
        return out

    @F.pandas_udf("array<struct<place: int, family: string, rank: int>>")
    def dealt(column: pd.Series) -> pd.Series:
        return pd.Series([deal(x) for x in column], dtype=object)

    slots = lists.select(record, F.explode(dealt("_l")).alias("_s")).select(record, "_s.place", F.col("_s.family").alias(family), F.col("_s.rank").alias("_r"))
    return slots.join(few, [record, family, "_r"]).select(record, "place", family, candidate)


def chosen(rows: DataFrame, record: str, candidate: str, similarity: str, seed: str) -> DataFrame:
    """Per record the severe choice (least similarity, then least id) and the standard one (first in a seeded order)."""
    severe = F.min(F.struct(F.col(similarity), F.col(candidate)))[candidate]
    standard = F.min(F.struct(seeded_order(seed, F.col(record), F.col(candidate)).alias("o"), F.col(candidate)))[candidate]
    return rows.groupBy(record).agg(severe.alias("severe"), standard.alias("standard"))


def most_disjoint(sets: list[int]) -> int:
    """The largest number of pairwise disjoint sets, given as bit masks."""
    ordered = sorted(sets, key=lambda m: m.bit_count())
    best = 0
    todo = [(0, 0, 0)]
    while todo:
        i, claimed, n = todo.pop()
        best = max(best, n)
        if i < len(ordered) and n + len(ordered) - i > best:
            todo.append((i + 1, claimed, n))
            if not ordered[i] & claimed:
                todo.append((i + 1, claimed | ordered[i], n + 1))
    return best


def footprint_packing(rows: DataFrame, record: str, elements: str) -> DataFrame:
    """(record, n_sets, most): of a record's sets (arrays of small integers) the largest number that don't overlap, exactly.

    Records have a dozen sets or so; each is one bit mask.
    """
    mask = F.expr(f"aggregate(`{elements}`, 0L, (s, x) -> s | shiftleft(1L, int(x)))")

    @F.pandas_udf("int")
    def packed(column: pd.Series) -> pd.Series:
        return pd.Series([most_disjoint([int(x) for x in m]) for m in column], dtype="int32")

    per = rows.select(record, mask.alias("_m")).groupBy(record).agg(F.collect_list("_m").alias("_m"))
    return per.select(record, F.size("_m").alias("n_sets"), packed("_m").alias("most"))
