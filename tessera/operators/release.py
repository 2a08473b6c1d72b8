"""Checks before a release: pairs of texts, coverage gates, resumed runs, stores, typed records, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.spans import apply_patches, piece


def codes(*tests: tuple[str, Column]) -> Column:
    """Names of the tests that hold, in order; an unknown test counts as one that holds."""
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(True)), F.lit(n)) for n, t in tests]))


def _faulty_spans(text: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < 0) | (s["end"] > F.length(text)) | (s["start"] >= s["end"]) | (piece(text, s["start"], s["end"]) != s["text"]))


def _overlapping(spans: Column) -> Column:
    ordered = F.array_sort(spans)
    pairs = F.zip_with(ordered, F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0))), lambda a, b: F.coalesce(b["start"] < a["end"], F.lit(False)))
    return F.exists(pairs, lambda x: x)


def pair_issues(pairs: DataFrame, h: str = "h", n: str = "n") -> Column:
    """Names of the invariants that a pair of structs breaks.

    Each side holds origin, subtask, label, text, sha, edits and spans (start, end, text, id); ``same_length`` of h says
    whether the texts should be equally long. Spans of both sides belong together by id, and putting n's texts into h's
    spans must give n's text.
    """
    a, b = (lambda c: F.col(f"{h}.{c}")), (lambda c: F.col(f"{n}.{c}"))
    ids = lambda side: F.array_sort(F.transform(side("spans"), lambda s: s["id"]))
    other = F.map_from_entries(F.transform(F.array_distinct(F.transform(b("spans"), lambda s: s["id"])), lambda i: F.struct(i, F.filter(b("spans"), lambda s: s["id"] == i)[0]["text"])))
    restored = apply_patches(a("text"), F.transform(a("spans"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.coalesce(F.element_at(other, s["id"]), F.lit("")).alias("text"))))
    return codes(
        ("missing_side", F.col(h).isNull() | F.col(n).isNull()), ("identity", (a("origin") != b("origin")) | (a("subtask") != b("subtask"))), ("polarity", (a("label") != "H") | (b("label") != "N")),
        ("text_hash", (F.sha2(a("text"), 256) != a("sha")) | (F.sha2(b("text"), 256) != b("sha"))), ("offsets", _faulty_spans(a("text"), a("spans")) | _faulty_spans(b("text"), b("spans"))),
        ("overlap", _overlapping(a("spans")) | _overlapping(b("spans"))), ("controls", (ids(a) != ids(b)) | (F.size(F.array_distinct(ids(a))) != F.size(a("spans")))),
        ("edit_count", F.size(a("spans")) != a("edits")), ("length_flag", a("same_length") != (F.length(a("text")) == F.length(b("text")))), ("substitution", restored != b("text")), ("unchanged", a("text") == b("text")),
    )


def gate(records: DataFrame, expected: DataFrame, keys: list[str], fixed: list[str]) -> DataFrame:
    """Issues (keys, code, field) of records against expected rows: missing, unexpected, repeated, or with another fixed field."""
    e = expected.select(*keys, F.lit(True).alias("_e"), *[F.col(f).alias(f"_e_{f}") for f in fixed])
    n = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.min(F.struct(F.col(f).alias("v"))).alias(f"_lo_{f}") for f in fixed], *[F.max(F.struct(F.col(f).alias("v"))).alias(f"_hi_{f}") for f in fixed])
    j = e.join(n, keys, "full_outer")
    issue = lambda test, code, field: F.when(test, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field")))
    both = F.col("_e").isNotNull() & F.col("_n").isNotNull()
    differs = [issue(both & (~F.col(f"_lo_{f}.v").eqNullSafe(F.col(f"_e_{f}")) | ~F.col(f"_hi_{f}.v").eqNullSafe(F.col(f"_e_{f}"))), "changed", f) for f in fixed]
    found = F.array_compact(F.array(issue(F.col("_n").isNull(), "missing", ""), issue(F.col("_e").isNull(), "unexpected", ""), issue(F.col("_n") > 1, "repeated", ""), *differs))
    return j.select(*keys, F.explode(found).alias("_i")).select(*keys, "_i.code", "_i.field")


def resume_state(requests: DataFrame, done: DataFrame, key: str, request: str, finish: str, terminal: tuple[str, ...] = ("stop", "length")) -> DataFrame:
    """(key, state): what a resumed run finds for each request: done, open, unknown, repeated, changed or not terminal."""
    r = requests.select(key, F.col(request).alias("_r"), F.lit(True).alias("_known"))
    d = done.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(request).alias("_lo"), F.max(request).alias("_hi"), F.bool_and(F.coalesce(F.col(finish).isin(*terminal), F.lit(False))).alias("_end"))
    state = (
        F.when(F.col("_known").isNull(), "unknown").when(F.col("_n").isNull(), "open").when(F.col("_n") > 1, "repeated")
        .when(~F.col("_lo").eqNullSafe(F.col("_r")) | ~F.col("_hi").eqNullSafe(F.col("_r")), "changed").when(~F.col("_end"), "not_terminal").otherwise("done")
    )
    return r.join(d, key, "full_outer").select(key, state.alias("state"))


def store_manifest(rows: DataFrame, shard: list[str], id_col: str, size: str) -> DataFrame:
    """Per shard: rows, size and a digest of its sorted ids. A shard's rows are bounded by the capacity it was packed to."""
    ids = F.array_join(F.array_sort(F.collect_list(id_col)), ",")
    return rows.groupBy(*shard).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(size).alias("n_units"), F.sha2(ids, 256).alias("sha"))


def record_issues(record: Column, fields: list[tuple[str, str]]) -> Column:
    """Issues (field, code, found, sha) of a JSON record against (field, type): syntax, missing, type, blank.

    Types are STRING, BIGINT, DOUBLE, BOOLEAN; evidence is the type found and a digest, never the value.
    """
    v = F.try_parse_json(record)
    issue = lambda test, field, code, found, value: F.when(test, F.struct(F.lit(field).alias("field"), F.lit(code).alias("code"), found.alias("found"), F.sha2(value, 256).alias("sha")))
    out = [issue(v.isNull(), "", "syntax", F.lit(None).cast("string"), record)]
    for name, kind in fields:
        value = F.try_variant_get(v, f"$.{name}", "variant")
        found, text = F.schema_of_variant(value), F.try_variant_get(v, f"$.{name}", "string")
        absent = value.isNull() | F.is_variant_null(value)
        ok = found == kind if kind != "DOUBLE" else found.rlike("^(DOUBLE|DECIMAL.*)$")
        out += [issue(v.isNotNull() & absent, name, "missing", F.lit(None).cast("string"), F.lit(None).cast("string")), issue(~absent & ~ok, name, "type", found, text)]
        if kind == "STRING":
            out.append(issue(~absent & ok & (F.btrim(text) == ""), name, "blank", found, text))
    return F.array_compact(F.array(*out))


def inventory(rows: DataFrame, task: str, record: Column, template: DataFrame) -> DataFrame:
    """Per task and field: how many JSON records hold it, whether the template (task, fields) names it, and ``status``."""
    held = rows.select(F.col(task).alias("task"), F.explode(F.json_object_keys(record)).alias("field")).groupBy("task", "field").agg(F.count(F.lit(1)).alias("n"))
    want = template.select(F.col(task).alias("task"), F.explode("fields").alias("field"), F.lit(True).alias("_t"))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("_t").isNull(), "unexpected").otherwise("held")
    return held.join(want, ["task", "field"], "full_outer").select("task", "field", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))
