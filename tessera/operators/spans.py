"""Character spans in code points, half-open: patches, coverage, token labels, slots, assembly."""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Offsets that share a bucket in the interval join.
BUCKET = 64


def piece(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


def apply_patches(text: Column, patches: Column) -> Column:
    """Splices patches (start, end, text) that don't overlap, from the right so that offsets stay valid."""
    ordered = F.reverse(F.array_sort(patches))
    return F.aggregate(ordered, text, lambda t, p: F.concat(F.left(t, p["start"].cast("int")), p["text"], F.substring(t, (p["end"] + 1).cast("int"), F.length(t))))


def moved_spans(patches: Column) -> Column:
    """Where each patch lies in the patched text: (start, end, text), by the length that earlier ones added."""
    empty = F.expr("named_struct('shift', 0L, 'out', cast(array() AS array<struct<start: bigint, end: bigint, text: string>>))")

    def step(s: Column, p: Column) -> Column:
        start = p["start"] + s["shift"]
        end = start + F.length(p["text"])
        at = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), p["text"].alias("text")))
        return F.struct((s["shift"] + F.length(p["text"]) - (p["end"] - p["start"])).cast("long").alias("shift"), F.concat(s["out"], at).alias("out"))

    return F.aggregate(F.array_sort(patches), empty, step, lambda s: s["out"])


def patch_faults(text: Column, patches: Column) -> Column:
    """Names of what's wrong with a patch list: overlap, shared start, no-op, out of bounds."""
    s = F.array_sort(patches)
    near = lambda test: F.exists(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda i: F.coalesce(test(F.get(s, i - 1), F.get(s, i)), F.lit(False)))
    return F.array_compact(F.array(
        F.when(near(lambda a, b: b["start"] < a["end"]), F.lit("overlap")), F.when(near(lambda a, b: b["start"] == a["start"]), F.lit("shared_start")),
        F.when(F.exists(s, lambda p: piece(text, p["start"], p["end"]) == p["text"]), F.lit("no_op")), F.when(F.exists(s, lambda p: (p["start"] < 0) | (p["end"] > F.length(text)) | (p["start"] > p["end"])), F.lit("bounds")),
    ))


def masked(text: Column, spans: Column) -> Column:
    """Ranges overwritten with spaces; the length stays."""
    return F.aggregate(spans, text, lambda t, p: F.overlay(t, F.repeat(F.lit(" "), (p["end"] - p["start"]).cast("int")), (p["start"] + 1).cast("int"), (p["end"] - p["start"]).cast("int")))


def occurrences(text: Column, needle: Column) -> Column:
    """How often a non-empty needle occurs without overlap."""
    return F.when(F.length(needle) > 0, (F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).otherwise(0).cast("long")


def parse_markers(text: Column, name: str = "MARK") -> Column:
    """(text, marks) of ``[[NAME:id]]value[[/NAME]]`` markup: clean text and (id, value, start, end) in it.

    Null where marks are nested or not closed.
    """
    parts = F.split(text, f"\\[\\[{name}:")
    start = F.expr("named_struct('text', '', 'marks', cast(array() AS array<struct<id: string, value: string, start: bigint, end: bigint>>), 'ok', true)")
    close = f"[[/{name}]]"

    def step(s: Column, p: Column, i: Column) -> Column:
        ident, rest = F.substring_index(p, "]]", 1), F.substring(p, F.instr(p, "]]") + 2, F.length(p))
        value, tail = F.substring_index(rest, close, 1), F.substring(rest, F.instr(rest, close) + len(close), F.length(rest))
        at = F.length(s["text"]).cast("long")
        mark = F.array(F.struct(ident.alias("id"), value.alias("value"), at.alias("start"), (at + F.length(value)).alias("end")))
        good = (F.instr(p, "]]") > 0) & (occurrences(rest, F.lit(close)) == 1)
        return F.struct(F.concat(s["text"], value, tail).alias("text"), F.concat(s["marks"], mark).alias("marks"), (s["ok"] & good).alias("ok"))

    first = F.element_at(parts, 1)
    init = F.struct(first.alias("text"), start["marks"].alias("marks"), (occurrences(first, F.lit(close)) == 0).alias("ok"))
    return F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), init, lambda s, p: step(s, p, F.lit(0)), lambda s: F.when(s["ok"], F.struct(s["text"].alias("text"), s["marks"].alias("marks"))))


_TOKEN = regex.compile(r"\p{L}+|[0-9]+|[^ \t-\r]")
_TOKENS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))


#: Tokens that are held as Python objects at once.
_HELD = 100_000


def token_arrays(texts: pa.Array) -> pa.Array:
    """Tokens of each text as Arrow lists of (start, end, text); about _HELD tokens, or one text's, are Python objects at once."""
    parts, done = [], 0
    offsets, starts, ends, words = [0], [], [], []
    for i in range(len(texts)):
        for m in _TOKEN.finditer(texts[i].as_py() or ""):
            starts.append(m.start())
            ends.append(m.end())
            words.append(m.group())
        offsets.append(len(starts))
        if len(starts) >= _HELD or i == len(texts) - 1:
            tokens = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(words, pa.string())], fields=list(_TOKENS.value_type))
            parts.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens, mask=texts[done : i + 1].is_null()))
            done, offsets, starts, ends, words = i + 1, [0], [], [], []
    return pa.concat_arrays(parts) if parts else pa.array([], _TOKENS)


def word_tokens(text: Column) -> Column:
    """Tokens of runs of letters, runs of digits and single other signs that aren't ASCII white space, as (start, end, text).

    Offsets count code points. Arrow-batched: with built-in functions each token is a step of an interpreted fold.
    """
    return F.arrow_udf(token_arrays, "array<struct<start: bigint, end: bigint, text: string>>")(text)


def overlap_join(tokens: DataFrame, spans: DataFrame, doc: str) -> DataFrame:
    """Pairs of token and span of one document that overlap: an equi-join on buckets of offsets, never all pairs.

    tokens: (doc, index, start, end); spans: (doc, label, s_start, s_end). A pair is reported in the bucket
    where its overlap begins, so once.
    """
    bucket = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / BUCKET), F.floor((F.greatest(F.col(b), F.col(a) + 1) - 1) / BUCKET)))
    t = tokens.withColumn("_b", bucket("start", "end"))
    s = spans.withColumn("_b", bucket("s_start", "s_end"))
    j = t.join(s, [doc, "_b"]).filter("start < s_end AND s_start < end AND start < end AND s_start < s_end")
    return j.filter(F.col("_b") == F.floor(F.greatest("start", "s_start") / BUCKET)).drop("_b")


def label_tokens(tokens: DataFrame, spans: DataFrame, doc: str) -> DataFrame:
    """Per token: sorted labels of the spans over it, plus ``unchanged`` where a character of it is uncovered."""
    hits = overlap_join(tokens, spans, doc)
    cover = union_length(hits.select(doc, "index", F.greatest("start", "s_start").alias("a"), F.least("end", "s_end").alias("b")), [doc, "index"], "a", "b")
    labels = hits.groupBy(doc, "index").agg(F.collect_set("label").alias("_labels"))
    j = tokens.join(labels, [doc, "index"], "left").join(cover, [doc, "index"], "left")
    bare = F.coalesce("covered", F.lit(0)) < F.col("end") - F.col("start")
    found = F.coalesce("_labels", F.array().cast("array<string>"))
    return j.select(doc, "index", "start", "end", F.array_sort(F.when(bare | (F.col("end") == F.col("start")), F.concat(found, F.array(F.lit("unchanged")))).otherwise(found)).alias("labels"))


def union_length(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Length of the union of ranges per key: each range adds what lies beyond the furthest end before it."""
    w = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(end).over(w), F.lit(0))
    add = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), reach))
    return spans.withColumn("_add", add).groupBy(*keys).agg(F.sum("_add").cast("long").alias("covered"))


def placed_pieces(pieces: DataFrame, doc: str, order: str, text: str, gap: int = 0) -> DataFrame:
    """Adds start and end of each piece in the text that joins them in order with ``gap`` characters between."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + gap).over(w), F.lit(0))
    return pieces.withColumn("start", start.cast("long")).withColumn("end", (start + F.length(text)).cast("long"))
