"""Span, template and text-audit queries; texts with known answers are generated from table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import spans as sp
from tessera.plans.registry import query
from tessera.session import table


@query("SELECT l_orderkey, l_linenumber, a || ' - ' || b || ' = ' || c AS statement, a - b <> c AS wrong FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) + 60 AS a, CAST(l_linenumber AS BIGINT) AS b, CAST(l_quantity AS BIGINT) + 60 - l_linenumber + CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END AS c FROM lineitem)")
def arithmetic_audit(spark, sf_dir):
    a, b = F.col("l_quantity").cast("long") + 60, F.col("l_linenumber").cast("long")
    c = a - b + F.when(F.col("l_orderkey") % 5 == 0, 1).otherwise(0)
    text = F.concat(F.lit("So "), a, F.lit(" - "), b, F.lit(" = "), c, F.lit(" holds, and 2 + 3.50 = 5.5 too."))
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("t"), F.concat(a, F.lit(" - "), b, F.lit(" = "), c).alias("statement"))
    return l.select("l_orderkey", "l_linenumber", "statement", F.array_contains(tx.false_equations(F.col("t")), F.col("statement")).alias("wrong"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS quantity, l_shipmode_ AS flag, true AS round_trip FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_ FROM lineitem)")
def template_parse(spark, sf_dir):
    """A template rendered from columns, parsed back by its anchored pattern and rendered again."""
    render = lambda q, f: F.concat(F.lit("take(quantity="), q, F.lit(', flag="'), f, F.lit('")'))
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", render(F.col("l_quantity").cast("long").cast("string"), F.concat("l_returnflag", "l_linestatus")).alias("formal"))
    pattern = '^take\\(quantity=(-?[0-9]+), flag="([^"]*)"\\)$'
    q, f = F.regexp_extract("formal", pattern, 1), F.regexp_extract("formal", pattern, 2)
    return l.select("l_orderkey", "l_linenumber", q.cast("long").alias("quantity"), f.alias("flag"), (render(q, f) == F.col("formal")).alias("round_trip"))


@query("SELECT o_orderkey AS id, left(t, 5) || 'XYZ' || substr(t, 8, 4) || substr(t, 15) AS patched, t AS restored, 5 AS first_start, 8 AS first_end, 12 AS second_start, 12 AS second_end FROM (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || o_orderpriority || '_' || o_orderstatus AS t FROM orders)")
def patch_compile(spark, sf_dir):
    """Two patches are spliced in, the spans move, and the inverse patches give the text back."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), "o_orderpriority", F.lit("_"), "o_orderstatus").alias("t"))
    fields = "start: bigint, end: bigint, text: string"
    patches = F.expr(f"from_json('[{{\"start\":11,\"end\":14,\"text\":\"\"}},{{\"start\":5,\"end\":7,\"text\":\"XYZ\"}}]', 'array<struct<{fields}>>')")
    o = o.withColumn("p", F.array_sort(patches)).withColumn("patched", sp.apply_patches(F.col("t"), F.col("p"))).withColumn("moved", sp.moved_spans(F.col("p")))
    inverse = F.zip_with("moved", "p", lambda m, p: F.struct(m["start"].alias("start"), m["end"].alias("end"), sp.piece(F.col("t"), p["start"], p["end"]).alias("text")))
    at = lambda i, c: F.col("moved")[i][c].cast("int")
    return o.select("id", "patched", sp.apply_patches(F.col("patched"), inverse).alias("restored"), at(0, "start").alias("first_start"), at(0, "end").alias("first_end"), at(1, "start").alias("second_start"), at(1, "end").alias("second_end"))


@query("SELECT doc_id, left(text, 3) || repeat(' ', least(4, greatest(length(text) - 3, 0))) || substr(text, 8) AS hidden FROM documents WHERE length(text) >= 10")
def masking(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.length("text") >= 10)
    return d.select("doc_id", sp.masked(F.col("text"), F.expr("array(named_struct('start', 3L, 'end', 7L))")).alias("hidden"))


@query("SELECT o_orderkey AS id, 'before ' || o_orderpriority || ' mid ' || o_orderstatus || ' end' AS clean, 'k' || o_custkey AS first_id, 7 AS first_start, CAST(7 + length(o_orderpriority) AS INTEGER) AS first_end, CAST(12 + length(o_orderpriority) AS INTEGER) AS second_start FROM orders")
def marker_parse(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.concat(F.lit("before [[MARK:k"), "o_custkey", F.lit("]]"), "o_orderpriority", F.lit("[[/MARK]] mid [[MARK:s]]"), "o_orderstatus", F.lit("[[/MARK]] end"))
    p = o.select(F.col("o_orderkey").alias("id"), sp.parse_markers(text).alias("p"))
    m = lambda i, c: F.col("p.marks")[i][c]
    return p.select("id", F.col("p.text").alias("clean"), m(0, "id").alias("first_id"), m(0, "start").cast("int").alias("first_start"), m(0, "end").cast("int").alias("first_end"), m(1, "start").cast("int").alias("second_start"))


_SPANS = "WITH s AS (SELECT l_orderkey AS doc, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS a, CAST(l_quantity + 1 + l_linenumber * 3 AS BIGINT) AS b FROM lineitem)"


@query(_SPANS + ", m AS (SELECT *, coalesce(max(b) OVER (PARTITION BY doc ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM s) SELECT doc, CAST(sum(greatest(0, b - greatest(a, reach))) AS BIGINT) AS covered FROM m GROUP BY doc")
def span_union_coverage(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_quantity").cast("long").alias("a"), (F.col("l_quantity") + 1 + F.col("l_linenumber") * 3).cast("long").alias("b"))
    return sp.union_length(l, ["doc"], "a", "b")


@query(_SPANS + ", t AS (SELECT DISTINCT doc, CAST(i AS BIGINT) AS i, CAST(i * 4 AS BIGINT) AS x, CAST(i * 4 + 4 AS BIGINT) AS y FROM s, (SELECT unnest(range(0, 16)) AS i)), j AS (SELECT t.doc, i, x, y, n, c FROM t JOIN (SELECT doc, n, unnest(range(a, b)) AS c FROM s) USING (doc) WHERE c >= x AND c < y), g AS (SELECT doc, i, list_sort(list(DISTINCT 'r' || n)) AS l, count(DISTINCT c) AS k FROM j GROUP BY ALL) SELECT t.doc, t.i AS index, list_sort(CASE WHEN coalesce(k, 0) < 4 THEN list_append(coalesce(l, []), 'unchanged') ELSE l END) AS labels FROM t LEFT JOIN g ON g.doc = t.doc AND g.i = t.i")
def token_label_join(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    spans = l.select(F.col("l_orderkey").alias("doc"), F.concat(F.lit("r"), "l_linenumber").alias("label"), F.col("l_quantity").cast("long").alias("s_start"), (F.col("l_quantity") + 1 + F.col("l_linenumber") * 3).cast("long").alias("s_end"))
    index = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("index")
    tokens = spans.select("doc").distinct().select("doc", index).select("doc", "index", (F.col("index") * 4).alias("start"), (F.col("index") * 4 + 4).alias("end"))
    return sp.label_tokens(tokens, spans, "doc").select("doc", "index", "labels")


@query("WITH o AS (SELECT l_orderkey AS doc, CAST(l_linenumber AS BIGINT) AS i, 'step ' || l_returnflag || repeat('x', CAST(l_linenumber AS INTEGER)) AS t FROM lineitem) SELECT doc, i, CAST(coalesce(sum(length(t) + 2) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(coalesce(sum(length(t) + 2) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(t) AS BIGINT) AS \"end\" FROM o")
def assemble_offsets(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("i"), F.concat(F.lit("step "), "l_returnflag", F.repeat(F.lit("x"), F.col("l_linenumber").cast("int"))).alias("t"))
    return sp.placed_pieces(l, "doc", "i", "t", 2).select("doc", "i", "start", "end")


@query("SELECT o_orderkey AS id, '<MOLECULE>m' || o_custkey || '</MOLECULE><ANSWER>' || o_orderstatus || '</ANSWER>' AS shown, CAST(10 AS BIGINT) AS first_start, CAST(10 + length('m' || o_custkey) + length('</MOLECULE><ANSWER>') AS BIGINT) AS second_start, sha256('<MOLECULE>m' || o_custkey || '</MOLECULE><ANSWER>' || o_orderstatus || '</ANSWER>') AS sha FROM orders")
def detector_text(spark, sf_dir):
    """A tagged text with its parts' offsets by construction, never by search."""
    o = table(spark, sf_dir, "orders")
    parts = [F.lit("<MOLECULE>"), F.concat(F.lit("m"), "o_custkey"), F.lit("</MOLECULE><ANSWER>"), F.col("o_orderstatus"), F.lit("</ANSWER>")]
    text = F.concat(*parts)
    length = lambda n: sum((F.length(p) for p in parts[1:n]), F.length(parts[0])).cast("long")
    return o.select(F.col("o_orderkey").alias("id"), text.alias("shown"), length(1).alias("first_start"), length(3).alias("second_start"), tx.digest(text).alias("sha"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'C' || o_custkey WHEN 1 THEN 'last' WHEN 2 THEN '' ELSE 'line' || o_custkey END AS answer, CASE o_orderkey % 4 WHEN 0 THEN 'answer_tag' WHEN 1 THEN 'answer_tag' WHEN 2 THEN 'unclosed_think' ELSE 'answer_line' END AS method FROM orders")
def answer_extract(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 4
    response = (
        F.when(k == 0, F.concat(F.lit("<think>\n</think>\n<answer>\nC"), "o_custkey", F.lit("</answer>"))).when(k == 1, F.lit("<answer>first</answer> no <answer>last</answer>"))
        .when(k == 2, F.lit("<think>Answer: CCN")).otherwise(F.concat(F.lit("<think>Answer: wrong</think>\nAnswer: `line"), "o_custkey", F.lit("`")))
    )
    return o.select(F.col("o_orderkey").alias("id"), tx.extract_answer(response).alias("a")).select("id", "a.answer", "a.method")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'raw' WHEN o_orderkey % 3 = 1 THEN 'struct' ELSE 'result' END AS field, o_orderpriority AS text FROM orders")
def select_first_non_blank(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, p = F.col("o_orderkey") % 3, F.col("o_orderpriority")
    raw, struct = F.when(k == 0, F.concat(F.lit("```text\n"), p, F.lit("\n```"))).otherwise(F.lit("  \n")), F.when(k == 1, p)
    name, text = tx.first_non_blank(("raw", raw), ("struct", struct), ("result", p))
    return o.select(F.col("o_orderkey").alias("id"), name.alias("field"), text.alias("text"))


@query("SELECT o_orderkey AS id, sha256('{\"a\":' || o_custkey || ',\"b\":\"' || o_orderstatus || '\",\"c\":null}') AS sha FROM orders")
def canonical_json_digest(spark, sf_dir):
    j = tx.canonical_json(("b", F.col("o_orderstatus")), ("a", F.col("o_custkey")), ("c", F.lit(None).cast("string")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), tx.digest(j).alias("sha"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(t, '[A-Za-z\\x{C0}-\\x{24F}]+|[0-9]+|[^\\sA-Za-z\\x{C0}-\\x{24F}0-9]')) AS BIGINT) AS n_tokens, CAST(length(regexp_replace(t, '\\s', '', 'g')) AS BIGINT) AS n_covered FROM (SELECT doc_id, text AS t FROM documents)")
def word_tokens(spark, sf_dir):
    covered = lambda t: F.aggregate(t, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    # Both from one array: as two columns over it the texts would be cut twice.
    both = F.transform(F.array(sp.word_tokens(F.col("text"))), lambda t: F.struct(F.size(t).cast("long").alias("n_tokens"), covered(t).alias("n_covered")))
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(both))


@query("SELECT event_id, list_filter([CASE WHEN event_id % 4 = 0 THEN 'overlap' END, CASE WHEN event_id % 4 = 1 THEN 'shared_start' END, CASE WHEN event_id % 4 = 2 THEN 'no_op' END], lambda x: x IS NOT NULL) AS faults FROM events")
def patch_faults(spark, sf_dir):
    k = F.col("event_id") % 4
    p = lambda a, b, t: F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end"), F.lit(t).alias("text"))
    patches = F.when(k == 0, F.array(p(0, 3, "x"), p(2, 4, "y"))).when(k == 1, F.array(p(1, 1, "x"), p(1, 2, "y"))).when(k == 2, F.array(p(0, 2, "ab"))).otherwise(F.array(p(0, 1, "x"), p(3, 5, "")))
    return table(spark, sf_dir, "events").select("event_id", sp.patch_faults(F.lit("abcdef"), patches).alias("faults"))
