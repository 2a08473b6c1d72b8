"""Claim graphs: three-valued edge audits, propagation, differences, topological order."""

from __future__ import annotations


from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edge_status(relation: Column, source: Column, target: Column, delta: Column) -> Column:
    """Whether an edge holds: null where a value or the relation is unknown."""
    return (
        F.when(relation == "must_equal", source == target).when(relation == "delta_of", target == source + delta)
        .when(relation == "at_most", target <= source).when(relation == "at_least", target >= source).when(relation == "differs", source != target)
    )


def audit_edges(edges: DataFrame, values: DataFrame, record: str = "record") -> DataFrame:
    """Edges (record, edge, relation, source, target, delta) with the values of both ends and ``status``."""
    v = lambda end: values.select(record, F.col("node").alias(end), F.col("value").alias(f"{end}_value"))
    j = edges.join(v("source"), [record, "source"], "left").join(v("target"), [record, "target"], "left")
    return j.withColumn("status", edge_status(F.col("relation"), F.col("source_value"), F.col("target_value"), F.col("delta")))


def edge_report(audited: DataFrame, by: str) -> DataFrame:
    return audited.groupBy(by).agg(*[F.count_if(F.col("status").eqNullSafe(F.lit(v).cast("boolean"))).cast("long").alias(n) for v, n in ((True, "n_satisfied"), (False, "n_violated"), (None, "n_unknown"))])


def verdict(statuses: Column) -> Column:
    """fail before unknown before pass."""
    return F.when(F.exists(statuses, lambda s: s == F.lit(False)), F.lit("fail")).when(F.exists(statuses, lambda s: s.isNull()), F.lit("unknown")).otherwise(F.lit("pass"))


def semantic_differences(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Nodes whose value differs between two states; nulls equal nulls."""
    j = a.select(*keys, F.col(value).alias("before")).join(b.select(*keys, F.col(value).alias("after")), keys, "full_outer")
    return j.filter(~F.col("before").eqNullSafe(F.col("after")))


def topological_order(edges: DataFrame, record: str = "record") -> DataFrame:
    """Per record, node and place in the order that always takes the smallest free name; a cycle gives places of null.

    Graphs of one record are small (tens of nodes); a batch holds many records, as a call for each costs more than its order.
    """

    def order(sources: list[str], targets: list[str]) -> list[dict]:
        after: dict[str, list[str]] = {}
        waits: dict[str, int] = {}
        for s, t in zip(sources, targets, strict=True):
            after.setdefault(s, []).append(t)
            waits[t] = waits.get(t, 0) + 1
            waits.setdefault(s, 0)
        free = [n for n, w in waits.items() if not w]
        heapify(free)
        placed: list[str] = []
        while free:
            n = heappop(free)
            placed.append(n)
            for t in after.get(n, ()):
                waits[t] -= 1
                if not waits[t]:
                    heappush(free, t)
        return [{"node": n, "place": i} for i, n in enumerate(placed)] + [{"node": n, "place": None} for n, w in sorted(waits.items()) if w > 0]

    @F.pandas_udf("array<struct<node: string, place: bigint>>")
    def orders(sources: pd.Series, targets: pd.Series) -> pd.Series:
        return pd.Series([order(s, t) for s, t in zip(sources, targets, strict=True)], dtype=object)

    per = edges.groupBy(record).agg(F.collect_list(F.struct("source", "target")).alias("_e"))
    placed = per.select(record, orders(F.col("_e.source"), F.col("_e.target")).alias("_o"))
    return placed.select(F.col(record).alias("record"), F.explode("_o").alias("_o")).select("record", "_o.node", "_o.place")


def propagate(rows: DataFrame, rules: list[tuple[str, list[str], Column]]) -> DataFrame:
    """Recomputes derived columns in rule order where one of their inputs changed.

    Columns come in pairs x and x_new; a rule (column, inputs, expression over *_new) fires only where an
    input differs. ``events`` lists what was rewritten.
    """
    out, events = rows, []
    for target, inputs, value in rules:
        moved = F.lit(False)
        for i in inputs:
            moved = moved | ~F.col(i).eqNullSafe(F.col(f"{i}_new"))
        out = out.withColumn(f"{target}_new", F.when(moved, value).otherwise(F.col(f"{target}_new")))
        events.append(F.when(~F.col(target).eqNullSafe(F.col(f"{target}_new")), F.lit(target)))
    return out.withColumn("events", F.array_compact(F.array(*events)))


