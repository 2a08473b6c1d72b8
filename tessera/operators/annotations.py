"""Annotations and audits: bindings of nodes to text, node tables, diffs, losses, purity of splits, caches, phrases."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.release import codes
from tessera.operators.spans import occurrences, piece


def annotation_issues(text: Column, nodes: Column, bindings: Column, spans: Column) -> Column:
    """What's wrong with an annotated text.

    nodes: (node, changed, role, root_ids); bindings: (node, start, end, text, error); spans: (node, start, end, kind, root_ids).
    Roles of changed nodes are root or propagated, others' unchanged; error bindings and spans are the same set; a span's
    kind and roots are its node's; every node is bound, and each binding's text stands where it says.
    """
    of = lambda name: F.filter(nodes, lambda n: n["node"] == name)
    place = lambda xs: F.array_sort(F.transform(xs, lambda x: F.struct(x["node"], x["start"], x["end"])))
    bound = F.transform(bindings, lambda b: b["node"])
    return codes(
        ("role", F.exists(nodes, lambda n: F.when(n["changed"], ~n["role"].isin("root", "propagated")).otherwise(n["role"] != "unchanged"))),
        ("text", F.exists(bindings, lambda b: piece(text, b["start"], b["end"]) != b["text"])),
        ("unbound_changed", F.exists(nodes, lambda n: n["changed"] & ~F.array_contains(bound, n["node"]))), ("unbound", F.exists(nodes, lambda n: ~n["changed"] & ~F.array_contains(bound, n["node"]))),
        ("error_spans", place(F.filter(bindings, lambda b: b["error"])) != place(spans)),
        ("kind", F.exists(spans, lambda s: F.size(F.filter(of(s["node"]), lambda n: (n["role"] == s["kind"]) & (n["root_ids"] == s["root_ids"]))) == 0)),
    )


def node_states(before: Column, after: Column, paths: dict[str, str], roots: Column) -> Column:
    """(node, before, after, state) for each node's path in two JSON texts: root, propagated or unchanged."""
    b, a = F.try_parse_json(before), F.try_parse_json(after)

    def one(node: str, path: str) -> Column:
        x, y = F.try_variant_get(b, path, "string"), F.try_variant_get(a, path, "string")
        state = F.when(x.eqNullSafe(y), "unchanged").when(F.array_contains(roots, node), "root").otherwise("propagated")
        return F.struct(F.lit(node).alias("node"), x.alias("before"), y.alias("after"), state.alias("state"))

    return F.array(*[one(n, p) for n, p in paths.items()])


def bounding_edit(a: str | None, b: str | None) -> tuple[int, int, int, int] | None:
    """The smallest ranges of two texts that hold all their differences; an empty one is widened by a shared character."""
    if a is None or b is None or a == b:
        return None
    edits = [x[1:] for x in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if x[0] != "equal"]
    i, j, k, m = edits[0][0], edits[-1][1], edits[0][2], edits[-1][3]
    if i == j or k == m:
        if i and k:
            i, k = i - 1, k - 1
        elif j < len(a) and m < len(b):
            j, m = j + 1, m + 1
    return i, j, k, m


def text_diff(a: Column, b: Column) -> Column:
    """Arrow-batched: (a_start, a_end, b_start, b_end) of the bounding edit, null for equal or absent texts."""

    @F.pandas_udf("a_start long, a_end long, b_start long, b_end long")
    def diff(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        rows = [bounding_edit(x, y) or (None,) * 4 for x, y in zip(left, right, strict=True)]
        return pd.DataFrame(rows, columns=["a_start", "a_end", "b_start", "b_end"], dtype="Int64")

    return diff(a, b)


def next_token_loss(logprobs: Column, mask: Column) -> Column:
    """(loss sum, tokens): token t is scored by the distribution at t - 1, so entry t - 1 of ``logprobs``; only masked-in tokens count."""
    scored = F.zip_with(F.slice(logprobs, F.lit(1), F.greatest(F.size(logprobs) - 1, F.lit(0))), F.slice(mask, F.lit(2), F.greatest(F.size(mask) - 1, F.lit(0))), lambda p, m: F.when(m, -p))
    kept = F.filter(scored, lambda x: x.isNotNull())
    return F.struct(F.aggregate(kept, F.lit(0.0), lambda s, x: s + x).alias("loss"), F.size(kept).cast("long").alias("n"))


def split_purity(rows: DataFrame, id_col: str, group: str, split: str, expected: dict[str, int]) -> DataFrame:
    """(check, n_bad): ids and groups in several splits, repeated ids, rows of no known split, and splits of another size."""
    n = lambda name, bad: bad.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(name).alias("check"), "n_bad")
    several = lambda c: rows.groupBy(c).agg(F.min(split).alias("_lo"), F.max(split).alias("_hi")).filter("_lo <> _hi")
    sizes = rows.groupBy(split).agg(F.count(F.lit(1)).alias("_n"))
    want = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
    parts = [
        n("ids_in_several_splits", several(id_col)), n("groups_in_several_splits", several(group)), n("repeated_ids", rows.groupBy(id_col).count().filter("count > 1")),
        n("unknown_split", rows.filter(~F.coalesce(F.col(split).isin(*expected), F.lit(False)))), n("sizes", sizes.filter(F.element_at(want, F.col(split)) != F.col("_n"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The order of JSON types among mixed values.
TYPE_RANK = {"VOID": 0, "BOOLEAN": 1, "BIGINT": 2, "DECIMAL": 2, "DOUBLE": 2, "STRING": 3, "ARRAY": 4, "OBJECT": 5}


def value_key(value: Column) -> Column:
    """A sort key of mixed JSON values: type, number, then compact text."""
    v = F.try_parse_json(value)
    kind = F.regexp_extract(F.coalesce(F.schema_of_variant(v), F.lit("")), "^[A-Z]+", 0)
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_RANK.items() for x in kv]), kind)
    return F.struct(F.coalesce(rank, F.lit(9)).alias("type"), F.when(rank == 2, v.try_cast("double")).alias("number"), F.to_json(v).alias("text"))


def cached(requests: DataFrame, cache: DataFrame, key: str, metadata: list[str], body: str) -> DataFrame:
    """(key, state, body): hit, miss (absent, or stored under other metadata) or unreadable."""
    c = cache.select(key, F.lit(True).alias("_c"), F.col(body).alias("_body"), *[F.col(m).alias(f"_c_{m}") for m in metadata])
    same = F.lit(True)
    for m in metadata:
        same = same & F.col(m).eqNullSafe(F.col(f"_c_{m}"))
    j = requests.join(c, key, "left")
    state = F.when(F.col("_c").isNull() | ~same, "miss").when(F.try_parse_json(F.col("_body")).isNull(), "unreadable").otherwise("hit")
    return j.select(key, state.alias("state"), F.when(state == "hit", F.col("_body")).alias("body"))


def trace_status(prompt: Column, trace: Column, errors: Column, tokens: Column) -> Column:
    """(status, start, n_error_tokens): whether a trace can be found in its prompt once, and the tokens of it that errors touch.

    errors: (start, end) in the trace; tokens: (start, end) in the prompt.
    """
    start = (F.instr(prompt, trace) - 1).cast("long")
    status = F.when(trace.isNull() | (trace == ""), "no_supplied_trace").when(occurrences(prompt, trace) == 1, "available").otherwise("unavailable")
    hit = lambda t: F.exists(errors, lambda e: (t["start"] < e["end"] + start) & (e["start"] + start < t["end"]))
    ok = status == "available"
    return F.struct(status.alias("status"), F.when(ok, start).alias("start"), F.when(ok, F.size(F.filter(tokens, hit))).cast("long").alias("n_error_tokens"))


def phrase_issues(text: Column, counts: dict[str, Column]) -> Column:
    """Phrases ``N noun`` or ``a noun`` whose number isn't the noun's count, as (noun, stated, count); plurals end in s."""

    def one(noun: str, count: Column) -> Column:
        stated = F.transform(F.regexp_extract_all(text, F.lit(f"\\b([0-9]+|an?) {noun}s?\\b"), F.lit(1)), lambda x: F.when(x.rlike("^an?$"), 1).otherwise(x.try_cast("int")).cast("long"))
        return F.transform(F.filter(stated, lambda x: ~x.eqNullSafe(count.cast("long"))), lambda x: F.struct(F.lit(noun).alias("noun"), x.alias("stated"), count.cast("long").alias("count")))

    return F.concat(*[one(n, c) for n, c in counts.items()])


def sample_counts(rows: DataFrame, key: str, finish: str, n: int, terminal: tuple[str, ...] = ("stop", "length")) -> DataFrame:
    """(key, n, n_terminal, ok): whether each request has exactly n samples, all of them ended."""
    done = F.count_if(F.coalesce(F.col(finish).isin(*terminal), F.lit(False)))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), done.alias("n_terminal")).withColumn("ok", (F.col("n") == n) & (F.col("n_terminal") == n))


def edit_targets(nodes: DataFrame, record: str, group: str) -> DataFrame:
    """(record, group, value): groups of nodes (value, mutable) that can be edited: all mutable and of one value."""
    per = nodes.groupBy(record, group).agg(F.min("value").alias("value"), F.max("value").alias("_hi"), F.bool_and("mutable").alias("_m"), F.count("value").alias("_k"), F.count(F.lit(1)).alias("_n"))
    return per.filter("_m AND value = _hi AND _k = _n").select(record, group, "value")


def requested_edits(most: Column, mode: str, seed: str, key: Column, low: int = 1, high: int = 1) -> Column:
    """How many edits a record asks for: ``fixed`` (low), ``range`` (seeded, low to high) or ``maximum``; never over ``most``."""
    if mode == "maximum":
        return most
    if mode == "fixed":
        return F.least(F.lit(low), most)
    draw = F.conv(F.left(F.sha2(F.concat_ws(":", F.lit(seed), key.cast("string")), 256), F.lit(8)), 16, 10).cast("long")
    return F.least((F.lit(low) + draw % (high - low + 1)).cast("int"), most)


def with_suffix(text: Column, bindings: Column, suffix: Column, slot: Column) -> Column:
    """(text, bindings) after a suffix whose ``{}`` is filled by ``slot``: the slot's binding follows the text's length."""
    at = (F.length(text) + F.instr(suffix, "{}") - 1).cast("long")
    added = F.array(F.struct(at.alias("start"), (at + F.length(slot)).cast("long").alias("end"), slot.alias("text")))
    return F.struct(F.concat(text, F.replace(suffix, F.lit("{}"), slot)).alias("text"), F.concat(bindings, added).alias("bindings"))


def changed_fields(saved: DataFrame, again: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, fields): of each record the fields in which a recomputed table differs from the saved one; one-sided records as ``row``."""
    side = lambda d, p: d.select(key, F.lit(True).alias(f"{p}"), *[F.col(f).alias(f"{p}_{f}") for f in fields])
    j = side(saved, "_s").join(side(again, "_a"), key, "full_outer")
    both = F.col("_s").isNotNull() & F.col("_a").isNotNull()
    found = F.array_compact(F.array(F.when(~both, F.lit("row")), *[F.when(both & ~F.col(f"_s_{f}").eqNullSafe(F.col(f"_a_{f}")), F.lit(f)) for f in fields]))
    return j.select(key, found.alias("fields")).filter(F.size("fields") > 0)
