"""Operators of the core on small inputs with hand-checked results."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import stats as st
from tessera.functions import text as tx
from tessera.operators import claims as cl
from tessera.operators import manifests as mf
from tessera.operators import corpus as co
from tessera.operators import pairs as pa
from tessera.operators import spans as sp
from tessera.operators import vectors as ve
from tessera.operators.graph import connected_components


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_norm_covers_unicode_white_space(spark):
    assert one(spark, tx.norm(F.lit(" a  b\x1f\n c　"))) == "a b c"


@pytest.mark.parametrize("k,n,low,high", [(2, 9, 0.0632251071, 0.5474110309), (0, 11, 0.0, 0.2588329670), (0, 8, 0.0, 0.3244075649), (1, 3, 0.0614919447, 0.7923403992)])
def test_wilson(spark, k, n, low, high):
    lo, hi = st.wilson(F.lit(k), F.lit(n))
    assert one(spark, lo) == pytest.approx(low, abs=1e-9) and one(spark, hi) == pytest.approx(high, abs=1e-9)


def test_wilson_of_nothing_is_null(spark):
    assert one(spark, st.wilson(F.lit(0), F.lit(0))[0]) is None


@pytest.mark.parametrize("b,c,p", [(0, 0, 1), (1, 0, 1), (0, 2, 0.5), (4, 1, 0.375), (2, 7, 0.1796875), (0, 3, 0.25)])
def test_mcnemar(spark, b, c, p):
    assert one(spark, st.mcnemar(F.lit(b), F.lit(c))) == pytest.approx(p, abs=1e-12)


def test_mcnemar_of_large_counts_is_finite(spark):
    assert 0 < one(spark, st.mcnemar(F.lit(900), F.lit(1100))) < 1e-4


def test_entropy_counts_missing_as_a_class(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, None)], "i int, c string")
    r = st.entropy(rows, ["i"], "c").first()
    assert r.entropy == pytest.approx(1.5) and r.n_valid == 3


@pytest.mark.parametrize("text,answer,method", [
    ("<think>\n</think>\n<answer>\nCCO</answer>", "CCO", "answer_tag"), ("<think>CCN</think><answer>CCO</answer>", "CCO", "answer_tag"),
    ("<think>Answer: CCN", "", "unclosed_think"), ("Answer: CC\nanswer: `CO`", "CO", "answer_line"), ("none", "", "missing"), ("<answer>a b</answer>", "", "answer_tag"),
])
def test_extract_answer(spark, text, answer, method):
    assert tuple(one(spark, tx.extract_answer(F.lit(text)))) == (answer, method)


def test_false_equations(spark):
    assert one(spark, tx.false_equations(F.lit("14 - 9 = 5, 14 - 9 = 6, 1 + 2 + 0.5 = 3.5"))) == ["14 - 9 = 6"]


def test_redact(spark):
    got = one(spark, tx.redact(F.lit("Authorization: abc.def token=12345 sk-abcdefgh12")))
    assert "abc.def" not in got and "12345" not in got and "sk-abc" not in got


def test_components_join_over_a_bridge_and_keep_self_loops(spark):
    e = spark.createDataFrame([(1, 2), (3, 4), (4, 2), (9, 9), (7, 8)], "a long, b long")
    assert {(r.node, r.component) for r in connected_components(e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (9, 9), (7, 7), (8, 7)}


def test_components_of_a_long_chain_and_of_nothing(spark):
    e = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = connected_components(e).collect()
    assert len(got) == 61 and {r.component for r in got} == {0}
    assert connected_components(e.filter("a < 0")).count() == 0


def test_first_wins_is_independent_of_order(spark):
    rows = [(3, "x"), (1, "x"), (2, "y")]
    for order in (rows, rows[::-1]):
        got = {r.id: (r.kept, r.duplicate_of) for r in co.first_wins(spark.createDataFrame(order, "id long, k string"), "k", ["id"], "id").collect()}
        assert got == {1: (True, None), 2: (True, None), 3: (False, 1)}


def test_budget_overshoots_by_the_last_row(spark):
    rows = spark.createDataFrame([(1, 5), (2, 4), (3, 9)], "id int, t int").withColumn("s", F.lit(1))
    assert [r.id for r in co.budget_selection(rows, ["s"], F.lpad(F.col("id").cast("string"), 64, "0"), "t", F.lit(8)).orderBy("id").collect()] == [1, 2]


def test_blocked_reasons_lists_each_reason_once(spark):
    rows = spark.createDataFrame([(1, "q", ["m1", "m2"]), (2, "z", ["m9"]), (3, None, [])], "id int, q string, m array<string>")
    got = co.blocked_reasons(rows, [("question", "q", spark.createDataFrame([("q",), ("q",)], "b string")), ("molecule", "m", spark.createDataFrame([("m1",), ("m2",)], "b string"))])
    assert {r.id: r.reasons for r in got.collect()} == {1: ["question", "molecule"], 2: [], 3: []}


def test_donors_go_round_and_skip_the_own_owner(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (2, 1, "a"), (3, 2, "a"), (4, 1, "a"), (5, 7, "b")], "i int, o int, s string")
    assert {r.i: r.donor for r in pa.circular_donors(rows, "i", "o", "s").collect()} == {1: 3, 2: 3, 3: 4, 4: 3, 5: 1}


def test_join_issues(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (3, None)], "id int, f string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, None), (4, "w")], "id int, f string")
    got = {(r.id, r.code, r.field) for r in pa.join_issues(a, b, "id", ["f"]).collect()}
    assert got == {("2", "duplicate_left", None), ("2", "field_conflict", "f"), ("4", "left_orphan", None)} or got == {("2", "duplicate_left", None), ("2", "field_conflict", "f"), ("4", "right_orphan", None)}


def patches(*rows):
    return F.expr("array(" + ", ".join(f"named_struct('start', {a}L, 'end', {b}L, 'text', '{t}')" for a, b, t in rows) + ")")


def test_patches_fold_from_the_right(spark):
    assert one(spark, sp.apply_patches(F.lit("abcdef"), patches((0, 1, "X"), (3, 5, "")))) == "Xbcf"
    assert [tuple(x) for x in one(spark, sp.moved_spans(patches((0, 1, "XY"), (3, 5, ""))))] == [(0, 2, "XY"), (4, 4, "")]


def test_union_length(spark):
    s = spark.createDataFrame([(1, 0, 5), (1, 3, 8), (1, 10, 12), (1, 11, 12)], "d int, a int, b int")
    assert sp.union_length(s, ["d"], "a", "b").first().covered == 10


def test_markers_reject_unclosed_and_nested(spark):
    good = one(spark, sp.parse_markers(F.lit("x[[MARK:a]]vv[[/MARK]]y")))
    assert good.text == "xvvy" and tuple(good.marks[0]) == ("a", "vv", 1, 3)
    assert one(spark, sp.parse_markers(F.lit("x[[MARK:a]]vv"))) is None
    assert one(spark, sp.parse_markers(F.lit("[[MARK:a]]v[[MARK:b]]w[[/MARK]][[/MARK]]"))) is None


def test_label_tokens_over_bucket_edges(spark):
    t = spark.createDataFrame([(1, 0, 60, 70), (1, 1, 70, 71), (1, 2, 5, 5)], "d int, index int, start int, end int")
    s = spark.createDataFrame([(1, "a", 0, 65), (1, "b", 64, 200)], "d int, label string, s_start int, s_end int")
    assert {r["index"]: r.labels for r in sp.label_tokens(t, s, "d").collect()} == {0: ["a", "b"], 1: ["b"], 2: ["unchanged"]}


def test_reconstruction_metrics_are_the_known_ones(spark):
    x = [[0.0, 1.0], [1.0, 2.0], [10.0, 8.0], [20.0, 1.0]]
    d = [[1, 1], [2, 0], [3, 1], [0, 2]]
    rows = spark.createDataFrame([(a, [p + q for p, q in zip(a, b, strict=True)]) for a, b in zip(x, d, strict=True)], "x array<double>, r array<double>")
    m = ve.reconstruction(rows, "x", "r").first()
    assert m.mse == pytest.approx(2.5) and m.fvu == pytest.approx(0.0678541137, abs=1e-9) and m.cosine == pytest.approx(0.9388468725, abs=1e-9)
    assert m.relative_error == pytest.approx(0.6638620966, abs=1e-9) and m.norm_ratio == pytest.approx(1.5232768311, abs=1e-9)
    n = ve.normalizer(rows, "x").orderBy("dim").collect()
    assert [r.mean for r in n] == [7.75, 3.0] and n[0].scale == pytest.approx(6.0699052711, abs=1e-9)


def test_sparsemax_is_a_distribution(spark):
    p = one(spark, ve.sparsemax(F.array(F.lit(0.5), F.lit(2.0), F.lit(1.8))))
    assert sum(p) == pytest.approx(1) and p[0] == 0 and p[1] == pytest.approx(0.6)


def test_topological_order_takes_small_names_first_and_reports_cycles(spark):
    e = spark.createDataFrame([(1, "b", "c"), (1, "a", "c"), (2, "x", "y"), (2, "y", "x"), (2, "r", "x")], "record int, source string, target string")
    got = {(r.record, r.node): r.place for r in cl.topological_order(e).collect()}
    assert got == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (2, "r"): 0, (2, "x"): None, (2, "y"): None}


def test_verdict_order(spark):
    v = lambda *x: one(spark, cl.verdict(F.array(*[F.lit(y).cast("boolean") for y in x])))
    assert (v(True, None, False), v(True, None), v(True)) == ("fail", "unknown", "pass")


def test_strict_json_and_paths():
    from tessera.sources.readers import safe_path, strict_issue

    cases = {'{"a": 1}': None, '{"a":1,"a":2}': "duplicate_key", "[NaN]": "non_finite", "[1e999]": "non_finite", "{": "syntax", " ": "empty"}
    assert {t: strict_issue(t) for t in cases} == cases and strict_issue(None) == "empty"
    assert safe_path("/d/", "a/b.json") == "/d/a/b.json"
    for bad in ("/x", "../x", "a/../../b", ""):
        with pytest.raises(ValueError):
            safe_path("/d", bad)


def test_readers_by_suffix(spark, tmp_path):
    from tessera.sources.readers import scan

    (tmp_path / "a.jsonl").write_text('{"v": 1}\n\n{"v": 2}\n')
    (tmp_path / "a.json").write_text('[{"v": 1},\n {"v": 2}]')
    (tmp_path / "a.csv").write_text('v,w\n1,"a,b"\n2,c\n')
    (tmp_path / "a.txt").write_text("v\tw\n1\ta\n2\tb\n")
    for name in ("a.jsonl", "a.json", "a.csv", "a.txt"):
        assert sorted(int(r.v) for r in scan(spark, str(tmp_path / name)).collect()) == [1, 2]
    (tmp_path / "bad.json").write_text('[{"v": 1}')
    with pytest.raises(Exception):
        scan(spark, str(tmp_path / "bad.json"), "v int").collect()


def test_manifest_and_writers(spark, tmp_path):
    from tessera.sources.readers import file_hashes, manifest_issues
    from tessera.sources.writers import addressed, coverage, document_shards, write_shards

    m = spark.createDataFrame([("a", "1"), ("b", "01"), ("a", "3"), ("c", None)], "task string, n string")
    assert {(r.id, r.code) for r in manifest_issues(m, ["task"], "n").collect()} == {("b", "count_not_canonical"), ("c", "count_not_canonical"), ("a", "identity_repeats")}
    rows = spark.createDataFrame([(i, "s") for i in range(5)], "id int, s string")
    assert [(r.shard, r.line_index) for r in addressed(rows, ["s"], "id", 2).orderBy("id").collect()] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]
    write_shards(rows, str(tmp_path / "out"), ["s"])
    with pytest.raises(Exception):
        write_shards(rows, str(tmp_path / "out"), ["s"])
    assert all(len(r.sha256) == 64 for r in file_hashes(spark, str(tmp_path / "out")).collect())
    sizes = rows.withColumn("n", F.lit(4))
    assert [r.shard for r in document_shards(sizes, ["s"], "id", "n", 8).orderBy("id").collect()] == [0, 0, 1, 1, 2]
    got = coverage(spark.createDataFrame([(1,), (1,), (3,)], "k int"), spark.createDataFrame([(1,), (2,)], "k int"), ["k"])
    assert {(r.k, r.code) for r in got.collect()} == {(1, "duplicate"), (2, "missing"), (3, "unexpected")}


def test_learning_rate_and_entropy_are_math(spark):
    assert math.isclose(one(spark, F.log2(F.lit(8.0))), 3.0)


def test_word_tokens_of_whole_texts(spark):
    import re

    texts = ["Añb 12,c!\n\n x", "", None, " ", "word 1! " * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", sp.word_tokens(F.col("t")).alias("w")).collect()
    for i, got in rows:
        want = None if texts[i] is None else [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\W\d_]+|[0-9]+|\S", texts[i])]
        assert (got if got is None else [tuple(x) for x in got]) == want


def test_donors_of_strata_with_one_owner_equal_brute_force(spark, monkeypatch):
    from tessera.operators import pairs as pa

    monkeypatch.setattr(pa, "RUN_IDS", 5)
    rows = [(i, "o" if i in (3, 9, 10, 11, 12, 13, 14, 15, 16, 17, 40) else f"p{i % 2}", "lone" if i in (3, 9, 12, 40) else "s") for i in range(41)]
    got = {r.item: r.donor for r in pa.circular_donors(spark.createDataFrame(rows, "item long, owner string, stratum string"), "item", "owner", "stratum").collect()}
    for i, owner, stratum in rows:
        others = [x for x in rows[i + 1 :] + rows[:i] if x[1] != owner]
        assert got[i] == next((x[0] for x in others if x[2] == stratum), others[0][0])
    alone = spark.createDataFrame([(1, "o", "s"), (2, "o", "s")], "item long, owner string, stratum string")
    assert {r.donor for r in pa.circular_donors(alone, "item", "owner", "stratum").collect()} == {None}


def test_sums_and_quantiles_by_runs(spark):
    import random

    from tessera.operators import corpus as co

    rng = random.Random(1)
    rows = [(rng.choice("ab"), f"{rng.getrandbits(64):016x}", rng.randint(0, 9), rng.choice((0.0, 1.0, rng.random()))) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, d string, n long, v double")
    got = {(r.g, r.d): r.before for r in co.running_before(df, ["g"], "d", "n", "before").collect()}
    assert got == {(g, d): sum(n for g2, d2, n, _ in rows if g2 == g and d2 < d) for g, d, _, _ in rows}
    for p in (0.0, 0.3, 0.5, 1.0):
        want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", p).alias("q")).collect()}
        assert {r.g: round(r.quantile, 12) for r in co.exact_quantile(df, "g", "v", p, 0.0, 1.0, 64).collect()} == {g: round(q, 12) for g, q in want.items()}


def test_shards_and_addresses_over_several_writers(spark, monkeypatch):
    from tessera.sources import writers as wr

    monkeypatch.setattr(wr, "WRITER_IDS", 10)
    df = spark.createDataFrame([(i, "s", 30 if i % 7 == 0 else 4) for i in range(25)], "id long, s string, n long")
    assert [(r.shard, r.line_index) for r in wr.addressed(df, ["s"], "id", 4).orderBy("id").collect()] == [(i // 4, i % 4) for i in range(25)]
    shards = {}
    for r in wr.document_shards(df, ["s"], "id", "n", 12).collect():
        shards.setdefault((r.block, r.shard), []).append(r)
    for (block, shard), rows in shards.items():
        assert sum(r.n for r in rows) <= 12 or len(rows) == 1
        after = shards.get((block, shard + 1))
        assert after is None or sum(r.n for r in rows) + min(after, key=lambda r: r.id).n > 12


@pytest.mark.parametrize(
    ("text", "bad"),
    [
        ("It has 1 sulfur, 2 oxygens and 3 carbons, totaling 7 heavy atoms.", 1), ("It has 1 sulfur, 2 oxygens and 3 carbons, totaling 6 heavy atoms.", 0), ("four heavy atoms (a methyl, (two) oxygens, one nitrogen)", 0),
        ("five heavy atoms (a methyl, oxygens (two), one nitrogen)", 1), ("Rings: 2 (one pyridine ring (1), some fused rings)", 0), ("1,200 carbons and 3 oxygens = 5 heavy atoms", 0), ("", 0), (None, 0), ("no (numbers) = here", 0),
    ],
)
def test_false_totals(text, bad):
    from tessera.operators.drafts import false_totals

    assert len(false_totals(text)) == bad


def test_most_disjoint_equals_brute_force():
    import itertools
    import random

    from tessera.operators.evaluation import most_disjoint

    rng = random.Random(3)
    for _ in range(60):
        sets = [sum({1 << rng.randrange(8) for _ in range(rng.randint(1, 3))}) for _ in range(rng.randint(0, 7))]
        fits = lambda c: sum(m.bit_count() for m in c) == (__import__("functools").reduce(int.__or__, c, 0)).bit_count()
        assert most_disjoint(sets) == max(k for k in range(len(sets) + 1) for c in itertools.combinations(sets, k) if fits(c))


def test_text_operators_on_odd_rows(spark):
    from tessera.operators import drafts as dr

    df = spark.createDataFrame([(1, None), (2, ""), (3, "a \U0001f600 12 and 3"), (4, "<|im_start|>x")], "id long, t string")
    spans = {r.id: r.s for r in df.select("id", dr.match_spans(F.col("t"), "[0-9]+").alias("s")).collect()}
    assert spans[1] is None and spans[2] == [] and [(x.start, x.end, x.text) for x in spans[3]] == [(4, 6, "12"), (11, 12, "3")]
    assert {r.id: r.f for r in df.select("id", dr.flattened(F.col("t")).alias("f")).collect()} == {1: None, 2: None, 3: None, 4: None}
    chat = df.filter("id = 4").select(dr.rendered_chat(F.expr("array(named_struct('role', 'user', 'content', 'hi'), named_struct('role', 'assistant', 'content', concat(t, ' ok 7')))")).alias("r"))
    e = chat.select(dr.eligible_tokens(F.col("r.text"), F.col("r.spans")).alias("e")).first().e
    assert e.n_tokens == 41 and len(e.positions) == 3  # x, ok and 7: the tag in the content isn't learnt
    assert dr.compiled("a{n:int}")[0] == "^\\Qa\\E(-?[0-9]+)$"
    with pytest.raises(ValueError):
        dr.compiled("{n:int}{n:text}")
    back = spark.range(8).select("id", dr.mapped_back(F.col("id"), F.col("id") + 1, F.expr("array(named_struct('start', 2L, 'end', 3L, 'text', 'xyz'))"))["start"].alias("b"))
    assert [r.b for r in back.orderBy("id").collect()] == [0, 1, None, None, None, 3, 4, 5]


def test_gates_and_runs_treat_nulls_as_values(spark):
    from tessera.operators import release as rl

    e = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k long, f string")
    r = spark.createDataFrame([(1, None), (2, None), (4, "z"), (3, "y"), (3, "y")], "k long, f string")
    assert {tuple(x) for x in rl.gate(r, e, ["k"], ["f"]).collect()} == {(2, "changed", "f"), (4, "unexpected", ""), (3, "repeated", "")}
    done = spark.createDataFrame([(1, None, "stop"), (2, "x", None), (9, "q", "stop")], "k long, f string, e string")
    assert {tuple(x) for x in rl.resume_state(e, done, "k", "f", "e").collect()} == {(1, "done"), (2, "not_terminal"), (3, "open"), (9, "unknown")}
    j = spark.createDataFrame([(None,), ("",), ('{"id": 1, "kind": null}',)], "j string")
    assert [[x.code for x in r.i] for r in j.select(rl.record_issues(F.col("j"), [("id", "BIGINT"), ("kind", "STRING")]).alias("i")).collect()] == [["syntax"], ["syntax"], ["missing"]]


def test_windowed_counts_of_a_stream(spark, tmp_path):
    from datetime import datetime

    from tessera.streaming.ingest import stream_of, windowed_counts

    rows = [(datetime(2024, 1, 1, h, m), k) for h, m, k in ((0, 5, "a"), (0, 50, "a"), (0, 59, "b"), (1, 0, "a"))]
    df = spark.createDataFrame(rows, "ts timestamp, k string")
    df.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(stream_of(spark, str(tmp_path / "in"), df.schema), "ts", "k")
    stream.writeStream.format("memory").queryName("_windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.start.hour, r.k, r.n_rows) for r in spark.table("_windows").collect()) == [(0, "a", 2), (0, "b", 1), (1, "a", 1)]


def test_identity_conflicts_compare_nulls_and_report_rows_without_manifest(spark):
    r = spark.createDataFrame([(1, "a", "x", None), (2, "a", "y", None), (3, "b", None, "q"), (4, None, "x", "q"), (2, "a", "y", None)], "id int, k string, f string, g string")
    m = spark.createDataFrame([("a", "x", None), ("c", "x", "q")], "k string, f string, g string")
    got = sorted(map(tuple, mf.identity_conflicts(r, m, "k", "id", ["f", "g"]).collect()))
    assert got == [(2, "f", "y", "x"), (2, "f", "y", "x"), (3, "", None, None), (4, "", None, None)]
    assert mf.identity_conflicts(r, m, "k", "id", []).count() == 2


def test_name_lookup_counts_distinct_owners(spark):
    m = spark.createDataFrame([("a", "p"), ("a", "p"), ("b", "p"), ("b", "q"), ("c", None)], "name string, owner string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("a",), (None,)], "name string")
    got = {r[0]: tuple(r)[1:] for r in mf.name_lookup(asked, m, "name", "owner").collect()}
    assert got == {"a": (1, "p", "found"), "b": (2, None, "ambiguous"), "c": (0, None, "unknown"), "d": (0, None, "unknown"), None: (0, None, "unknown")}


def test_multiset_difference_counts_both_ways(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x"), (3, "y")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, "x"), (2, "x"), (4, "z")], "k int, v string")
    assert {tuple(r) for r in mf.multiset_difference(a, b, ["k", "v"]).collect()} == {(1, None, 1), (2, "x", -1), (3, "y", 1), (4, "z", -1)}
    assert mf.multiset_difference(a, a, ["k", "v"]).count() == 0


def test_axis_counts_and_identities_treat_nulls_as_values(spark):
    d = spark.createDataFrame([(1, "x"), (None, "x"), (2, None)], "n int, s string")
    got = {(r.axis, r.value): r.n for r in mf.axis_counts(d, {"s": F.col("s"), "n": F.col("n")}).collect()}
    assert got == {("s", "x"): 2, ("s", None): 1, ("n", "1"): 1, ("n", "2"): 1, ("n", None): 1}
    assert mf.axis_counts(d.limit(0), {"s": F.col("s")}).count() == 0
    broken = [r.b for r in d.select(mf.broken_identities({"one": F.col("n") == 1, "length": F.length("s") == 1}).alias("b")).collect()]
    assert broken == [[], ["one"], ["one", "length"]]
