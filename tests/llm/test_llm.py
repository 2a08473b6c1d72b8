"""The training-data operators against brute force, round trips and odd rows."""

import collections
import hashlib
import os
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries as q

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and white texts, repeated rows, a long text, and columns whose names the operators use inside.
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (5, "one"), (None, "one two three four five six"), (7, LONG), (8, LONG + " end"), (9, "é<s>\x1b 5kg. \U0001f600 Ünï"), (10, "a b c d e"), (11, "A b C d e")]
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", None if i == 4 else "s", None) for i, t in ODD]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(0) for c in ("size", "kept", "id", "th", "a", "b", "score", "_m", "target", "rank", "key", "x", "y", "bucket", "slot")})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def docs():
    return duckdb.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()


def set_of(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = {d: set_of(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


@needs_data
@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_near_dup_equals_brute_force(spark, sf):
    docs = duckdb.execute(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY 1").fetchall()
    got = q.op8_near_dup(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs) and len(got) == len(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dup_finds_links_that_no_centre_has(spark):
    """A chain in which the smallest id is far from most members."""
    base = [f"t{i}" for i in range(204)]
    rows = []
    for k in range(12):
        w = list(base)
        for j in range(k):
            w[j * 16 + 8] = f"z{j}"
        rows.append((100 - k, " ".join(w)))
    from tessera.llm.near_dup import near_duplicates

    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: c for d, (_, c) in brute_components(rows).items()}


def test_near_dup_searches_buckets_in_blocks(spark, monkeypatch):
    """A hub that shares half of its words with everything, and pairs among the others."""
    from tessera.llm import near_dup as nd

    monkeypatch.setattr(nd, "BLOCK", 1)
    rng = random.Random(9)
    base = [f"t{i}" for i in range(300)]
    rows = [(0, " ".join(base))]
    for k in range(1, 30):
        w = list(base)
        for j in rng.sample(range(300), 12 + k % 5):
            w[j] = f"z{k // 2 if k % 3 else k}_{j}"
        rows.append((k, " ".join(w)))
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: c for d, (_, c) in brute_components(rows).items()}


def test_near_dup_misses_a_pair_as_seldom_as_stated():
    from math import lgamma

    import numpy as np

    from tessera.llm import near_dup as nd

    above, below = np.array([(a, b) for a in range(nd.M + 1) for b in range(nd.M + 1 - a)]).T
    equal, ln = nd.M - above - below, np.array([lgamma(i + 1) for i in range(nd.M + 1)])
    j = nd.PERCENT / 100
    for ratio in (1, 0.97, 0.95, 0.9, 0.85, 0.8):
        u, v = ratio / (1 + ratio), 1 / (1 + ratio)
        p = np.exp(ln[nd.M] - ln[above] - ln[below] - ln[equal] + above * np.log(u - v * j) + below * np.log(v - u * j) + equal * np.log(j))
        low = p[nd.joint_estimate(np.array(ratio), np.array(1.0), above, below, equal) < nd.ESTIMATE].sum()
        assert abs(p.sum() - 1) < 1e-9 and low <= 1e-8 and (1 - j**nd.ROWS) ** nd.BANDS + low < 1e-7


def test_near_dup_of_odd_rows(odd, empty):
    from tessera.llm.near_dup import keep_one, near_duplicates

    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_duplicates(odd).collect()}
    assert near_duplicates(odd).count() == len(ODD)
    assert got[(1, 0)] == (1, True) and got[(2, 0)] == (2, True) and got[(5, 1)] == (4, False) and got[(11, 1)] == (10, False) and got[(None, 2)] == (None, False)
    assert [v for (d, _), v in got.items() if d == 8] == [(7, False)]
    assert near_duplicates(empty).count() == 0
    kept = keep_one(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 2, 3, 4, 7, 9, 10]


def test_register_estimate():
    import numpy as np

    from tessera.llm.near_dup import M, joint_estimate, registers

    rng = np.random.RandomState(0)
    pool = rng.randint(0, 1 << 62, 3000).astype(np.uint64)
    a, b = registers(pool[:2000]), registers(pool[500:2500])
    above, below = (a > b).sum(), (a < b).sum()
    assert abs(joint_estimate(2000.0, 2000.0, above, below, M - above - below) - 0.6) < 0.2
    assert (np.maximum(registers(pool[:900]), registers(pool[900:])) == registers(pool)).all()


def brute_repeats(rows, length=200):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = collections.Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    out = []
    for d, b in texts:
        mask = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        spans = sum(1 for i, m in enumerate(mask) if m and not (i and mask[i - 1]))
        rest = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        out.append((d, len(b), sum(mask), spans, hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("settings", [{}, {"hot": 1}, {"hot": 3}])
def test_repeats_equal_brute_force(spark, settings):
    from tessera.llm.suffix_dedup import remove_repeats

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(20, 60)))
    passages = ["".join(word() for _ in range(6))[:n] for n in (199, 200, 201, 230, 320, 329, 400)]
    rows = [(i, word() + "".join(rng.choice(passages) + word() for _ in range(rng.randint(0, 4)))) for i in range(40)]
    rows += [(90, "ab" * 300), (91, "x" * 450), (92, None), (93, ""), (94, rows[0][1]), (94, rows[1][1]), (None, rows[2][1])]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), **settings).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=key) == sorted(brute_repeats(rows), key=key)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_repeats_of_odd_rows(odd, empty):
    from tessera.llm.suffix_dedup import remove_repeats

    got = {r.doc_id: r for r in remove_repeats(odd).collect()}
    assert got[7].n_removed == got[7].n_bytes and got[1].n_bytes == 0 and got[9].n_removed == 0
    assert remove_repeats(empty).count() == 0


def test_long_texts_are_cut_into_overlapping_segments(spark, monkeypatch):
    from tessera.llm import suffix_dedup as sd

    monkeypatch.setattr(sd, "SEGMENT", 500)
    rng = random.Random(1)
    text = "".join(rng.choice("abcd") for _ in range(2000))
    rows = [(1, text + text[300:900]), (2, text[450:1400])]
    got = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(brute_repeats(rows))


def test_loser_tree_merges_and_knows_prefixes():
    from tessera.llm.suffix_dedup import merged, pack, unpack

    import numpy as np

    rng = random.Random(2)
    for n_runs in (1, 2, 3, 7):
        runs = [[bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 30))] for _ in range(n_runs)]
        got = list(merged([unpack(pack(r, np.zeros((len(r), 5), dtype=np.int64))) for r in runs]))
        want = sorted(k for r in runs for k in r)
        assert [g[0] for g in got] == want
        for (a, _, _), (b, common, _) in zip(got, got[1:], strict=False):
            assert common == len(os.path.commonprefix([a, b]))


def test_merged_prefixes_decide():
    """The same contexts with another common prefix give other spans: nothing else tells windows apart."""
    from tessera.llm import suffix_dedup as sd

    text = b"ab" * 130
    keys = [text[:199] + b"a", text[:199] + b"z"]
    spans = lambda c: [r for f in sd.settled(iter([(keys[0], 0, [1, 0, 0, 0, 0]), (keys[1], c, [2, 0, 0, 0, 0])])) for r in f[["id", "a", "b"]].to_numpy().tolist()]
    assert spans(199) == [] and sorted(spans(200)) == [[1, 0, 200], [2, 0, 200]]


@needs_data
def test_repeats_equal_brute_force_on_the_tables(spark, docs):
    got = q.op3_repeats(spark, SF).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(brute_repeats(docs))


@needs_data
def test_pii_equals_plain_patterns(docs):
    from tessera.llm.pii import BASE, KINDS, luhn, spans

    digits = lambda s: re.sub("[^0-9]", "", s)

    def plain(t):
        f = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        f += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
        f += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
        f += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m.group())) <= 15]
        return sorted(f, key=lambda x: (x[0], KINDS.index(x[2])))

    rng = random.Random(3)
    texts = [t for _, t in docs] + ["".join(rng.choice("a@.b-12 +@.") for _ in range(16)) for _ in range(20_000)]
    texts += ["".join(rng.choice("1234..") for _ in range(20)) for _ in range(20_000)] + ["+" + "".join(rng.choice("123 (.)-+") for _ in range(18)) for _ in range(20_000)]
    for t in texts:
        assert [x[:3] for x in spans(t) if x[2] in BASE] == plain(t), t


@pytest.mark.parametrize("piece", ["1", "1.", "1.1.1.", "1 ", "1-", "+1", "+1(", "a@", "a.", "@a.", "a@b.", "AB12", "AB12 ", "0123456789abcdef", "0123456789abcdef0123456789abcdef ", "AKIA", "ghp_", "123-45-", "é1"])
def test_pii_takes_time_in_proportion(piece):
    import time

    from tessera.llm.pii import spans

    began = time.time()
    spans(piece * (1_000_000 // len(piece)))
    assert time.time() - began < 5


def test_pii_context_is_of_whole_words():
    from tessera.llm.pii import spans

    token = "0123456789abcdef" * 2
    assert spans(f"monkey trip hotel {token}") == [] and spans(f"key {token}")[0][2] == "secret" and spans(f"api_key={token}")[0][2] == "secret"
    assert spans(f"{token} and token {token}") == [(43, 75, "secret", 0.9)]


def test_pii_query_and_added_kinds(spark, odd, empty):
    from tessera.llm.pii import find_pii, pii_summary, redact, spans

    assert spans("IBAN GB82 WEST 1234 5698 7654 32 ok")[0][2] == "iban" and not [x for x in spans("GB83 WEST 1234 5698 7654 32") if x[2] == "iban"]
    assert [x[2] for x in spans("social security 123-45-6789")] == ["ssn"] and spans("part 123-45-6789") == []
    rows = spark.createDataFrame([(1, "mail a.b@c.de, 10.0.0.1")], "doc_id long, text string")
    r = pii_summary(rows).first()
    assert (r.n_email, r.n_ip, r.spans) == (1, 1, "email:5:13,ip:15:23") and r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
    assert redact(find_pii(rows)).first().text == "mail [EMAIL], [IP]"
    assert pii_summary(odd).count() == len(ODD) and pii_summary(empty).count() == 0


@needs_data
def test_shards_are_a_shuffle(spark):
    got = q.op6_shards(spark, SF).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert [tuple(r) for r in sorted(got)] == [tuple(r) for r in sorted(q.op6_shards(spark, SF).collect())]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 97, 1000])
def test_feistel_is_a_permutation(spark, n):
    from tessera.llm.sharding import permuted

    assert sorted(r.p for r in spark.range(n).select(permuted("id", n, 3).alias("p")).collect()) == list(range(n))


def test_shards_of_odd_rows(odd, empty):
    from tessera.llm.sharding import assign_shards

    got = assign_shards(odd, n_shards=4).collect()
    assert len(got) == len(ODD) and sorted(r.position for r in got) == list(range(len(ODD)))
    crc = {r.doc_id: r.text_crc32 for r in got}
    assert crc[9] == zlib.crc32(ODD[9][1].encode()) and crc[1] == 0 and {r.doc_id: r["size"] for r in got}[1] == 1
    assert assign_shards(empty).count() == 0
    kept = assign_shards(odd.withColumn("a.b", F.lit(3)), n_shards=4, keep=("size", "slot", "lang", "a.b"))
    assert kept.columns == ["doc_id", "size", "text_crc32", "size_kept", "slot_kept", "lang", "a.b", "position", "shard", "slot"]
    assert {(r["size_kept"], r["lang"], r["a.b"]) for r in kept.collect()} == {(0, "en", 3)}


@needs_data
def test_chat_round_trip(spark):
    want = collections.defaultdict(list)
    for c, _, r, x in duckdb.execute(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet' ORDER BY ALL").fetchall():
        want[c].append((r, x))
    said = "</s>[INST] ok [/INST]"
    want[-1] = [("user", said), ("assistant", said)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = q.op7_chat(spark, SF).collect()
    assert {r.conv_id for r in got} == set(want)
    for r in got:
        t = want[r.conv_id]
        learnt = "".join(x for role, x in t if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(t), sha("".join(f"{a}\n{b}\n" for a, b in t)), len(learnt), sha(learnt))
        assert said not in r.formatted


def test_chat_escapes_anything(spark):
    from tessera.llm.chat_format import chain_of_turns, format_chats, read_back

    odd = ["\x1b", "<\x1b|im_start|>", "<|im_start|>", "a\n<|im_end|>\n", "\x1bn<s>\x1b\x1b<\x1bs>", "[[INST]", "<<s>", "\n", "", None]
    rows = [(i, 0, a, b) for i, (a, b) in enumerate((a, b) for a in odd for b in odd)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.tree: [(t.role, t.text) for t in r.t] for r in format_chats(chain_of_turns(df)).select("tree", read_back(F.col("formatted")).alias("t")).collect()}
    assert got == {i: [(a or "", b or "")] for i, _, a, b in rows}
    assert format_chats(chain_of_turns(df.filter("false"))).count() == 0


def test_reply_trees_rank_branches(spark):
    from tessera.llm.chat_format import best_paths, leaf_paths

    rows = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 5.0), (1, 4, 2, 1.0), (1, 5, 3, 0.0), (1, 6, 5, 0.0), (2, 9, 77, 1.0)]
    m = spark.createDataFrame([(t, n, p, "user", f"m{n}", s) for t, n, p, s in rows], "tree long, node long, parent long, role string, text string, score double")
    assert {(r.tree, r.leaf, r.node, r.up) for r in leaf_paths(m).collect()} == {(1, 4, 4, 0), (1, 4, 2, 1), (1, 4, 1, 2), (1, 6, 6, 0), (1, 6, 5, 1), (1, 6, 3, 2), (1, 6, 1, 3), (2, 9, 9, 0)}
    best = best_paths(m, 1).groupBy("tree").agg(F.min("leaf").alias("leaf"), F.count(F.lit(1)).alias("n")).collect()
    assert {(r.tree, r.leaf, r.n) for r in best} == {(1, 6, 4), (2, 9, 1)}


def test_reply_trees_of_odd_rows(spark, odd, empty):
    from tessera.llm.chat_format import chain_of_turns, format_chats, leaf_paths, read_back

    schema = "tree long, node long, parent long, role string, text string, score double"
    # A null tree; a reply given twice; a cycle without a leaf; a leaf under a cycle; a node that is its own parent.
    rows = [(None, 1, None, "user", "q", 1.0), (None, 2, 1, "assistant", "a", None), (1, 1, None, "user", "x", 0.0), (1, 2, 1, "assistant", "y", 1.0), (1, 2, 1, "assistant", "y", 1.0)]
    rows += [(2, 1, 2, "user", "c", 0.0), (2, 2, 1, "user", "c", 0.0), (3, 1, 2, "user", "c", 0.0), (3, 2, 1, "user", "c", 0.0), (3, 3, 1, "user", "c", 0.0), (3, 4, None, None, None, 0.0), (4, 1, 1, "user", "s", 0.0)]
    m = spark.createDataFrame(rows, schema).withColumns({c: F.lit(1) for c in ("leaf", "up", "branch", "v", "from", "to", "n")})
    assert {(r.tree, r.leaf, r.node, r.up) for r in leaf_paths(m).collect()} == {(None, 2, 2, 0), (None, 2, 1, 1), (1, 2, 2, 0), (1, 2, 1, 1), (3, 4, 4, 0)}
    got = {r.tree: [tuple(t) for t in r.t] for r in format_chats(m, 3).select("tree", read_back(F.col("formatted")).alias("t")).collect()}
    assert got == {None: [("user", "q"), ("assistant", "a")], 1: [("user", "x"), ("assistant", "y")], 3: [("", "")]}
    chats = format_chats(chain_of_turns(odd, "doc_id", "n_chars", "lang", "text")).select("tree", F.size(read_back(F.col("formatted"))).alias("n")).collect()
    assert {r.tree: r.n for r in chats} == collections.Counter(d for d, _ in ODD)
    assert format_chats(chain_of_turns(empty, "doc_id", "n_chars", "lang", "text")).count() == 0 and leaf_paths(m.filter("false")).count() == 0


def test_reply_trees_equal_brute_force(spark):
    from tessera.llm.chat_format import best_paths

    rng = random.Random(14)
    rows, want = [], {}
    for tree in range(40):
        n = rng.randint(1, 40)
        parent = {i: rng.randrange(i) if i and rng.random() < 0.95 else None for i in range(n)}
        score = {i: float(rng.randint(0, 5)) for i in range(n)}
        rows += [(tree, i, parent[i], "user", f"m{i}", score[i]) for i in range(n)]
        paths = []
        for leaf in set(range(n)) - {p for p in parent.values() if p is not None}:
            path = [leaf]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            paths.append((-sum(score[i] for i in path) / len(path), -len(path), leaf, path[::-1]))
        for k, x in enumerate(sorted(paths)[:3]):
            want[tree, k + 1] = x[3]
    m = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = collections.defaultdict(list)
    for r in best_paths(m, 3).orderBy(F.desc("up")).collect():
        got[r.tree, r.branch].append(r.node)
    assert dict(got) == want


def test_quality_rules_of_odd_rows(odd, empty):
    from tessera.llm.quality_rules import judged, keep_good

    got = {r.doc_id: r._quality for r in judged(odd).collect()}
    assert got[1].n_words == 0 and got[1].failed[0] == "too_short" and not got[3].kept
    assert got[7].n_words == 60_000 and got[7].n_repeat_words == 60_000
    assert keep_good(odd).columns == odd.columns and keep_good(empty).count() == 0


def test_repeat_words_equals_brute_force(spark):
    from tessera.llm.quality_rules import judged

    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdef"[: 2 + i % 5]) for _ in range(i % 40))) for i in range(200)]

    def brute(t):
        w = WORD.findall(t)
        n = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        return len({j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)})

    got = {r.doc_id: r._quality.n_repeat_words for r in judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute(t) for i, t in rows}


@needs_data
def test_quality_rules_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = q.op9_quality_rules(spark, SF)
    cur = con.execute(q.ORACLES["op9_quality_rules"])
    names = [d[0] for d in cur.description]
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(cur.fetchall())


def filled(sizes, weights, share=1.0, cap=3.0):
    """Targets by filling up in plain Python."""
    out, left, free = [0.0] * len(sizes), share * sum(sizes), [i for i, n in enumerate(sizes) if n > 0]
    while free:
        per = left / sum(weights[i] for i in free)
        full = [i for i in free if per * weights[i] >= cap * sizes[i]]
        for i in full or free:
            out[i] = float(cap * sizes[i]) if full else per * weights[i]
        left -= sum(out[i] for i in full)
        if not full:
            break
        free = [i for i in free if i not in full]
    return out


def test_targets_fill_and_cap(spark):
    from tessera.llm.mixing import with_targets

    rng = random.Random(21)
    cases = [([10, 10, 10], [1, 2, 3]), ([1, 100, 0], [3, 1, 5]), ([], []), ([0], [1]), *[([rng.choice((0, 1, 5, 50, 1000)) for _ in range(12)], [1 + i % 3 for i in range(12)]) for _ in range(6)]]
    assert filled([10, 10, 10], [1, 2, 3]) == pytest.approx([5, 10, 15]) and filled([1, 100, 0], [3, 1, 5]) == pytest.approx([3, 98, 0])
    for sizes, weights in cases:
        df = spark.createDataFrame(list(zip(range(len(sizes)), sizes, weights, strict=True)), "i long, source_size long, weight long")
        assert [r.target for r in with_targets(df).orderBy("i").collect()] == pytest.approx(filled(sizes, weights))


@needs_data
def test_mix_meets_targets_and_pieces_agree(spark):
    from tessera.llm.mixing import mix
    from tessera.session import table

    docs = table(spark, SF, "documents")
    rows, pieces = mix(docs)
    got = rows.collect()
    per = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        per[r.source][0] += r["size"]
        per[r.source][1] += r.taken
        per[r.source][2] = r.target
        assert r.taken <= 3 * r["size"] and r.source_size >= r["size"]
    assert len(got) == docs.count() and all(abs(t - g) <= 1 for _, t, g in per.values())
    assert sum(g for *_, g in per.values()) == pytest.approx(sum(s for s, *_ in per.values()))
    words = {r.doc_id: len(WORD.findall(r.text)) for r in docs.collect()}
    p = pieces.collect()
    assert sum(x.end - x.start for x in p) == sum(r.taken for r in got) and all(0 <= x.start < x.end <= words[x.doc_id] for x in p)


def golden(slots):
    """The schedule in plain Python: the source of each golden-ratio point, until every source has its slots."""
    from tessera.llm.mixing import GOLDEN, MOD_BITS

    total, edges = sum(slots), []
    for s in slots:
        edges.append((edges[-1] if edges else 0) + s)
    edges = [(e << MOD_BITS) // total for e in edges]
    had, out = [0] * len(slots), []
    for k in range(3 * total + 8):
        s = next(i for i, e in enumerate(edges) if (k * GOLDEN) % (1 << MOD_BITS) < e)
        if had[s] < slots[s]:
            out.append((k, s, had[s]))
            had[s] += 1
    return out


def test_schedule_is_even(spark):
    from tessera.llm.mixing import schedule

    rng = random.Random(3)
    for want in ([1, 500, 250, 249], [rng.choice((0, 1, 3, 40)) for _ in range(50)]):
        df = spark.createDataFrame([(i, n, i // 7) for i, n in enumerate(want)], "source_no long, slots long, _part int")
        rows = schedule(df).orderBy("slot").collect()
        assert [tuple(r) for r in rows] == golden(want)
    first = golden([1, 500, 250, 249])[:100]
    assert abs(sum(s == 1 for _, s, _ in first) - 50) <= 3 and abs(sum(s == 2 for _, s, _ in first) - 25) <= 3


def test_many_sources_are_put_in_order(spark):
    from tessera.llm.mixing import in_order

    rows = spark.createDataFrame([(None,), *[(f"s{i * 7919 % 1000}",) for i in range(1000)]], "s string").distinct()
    got = in_order(rows, [F.col("s").isNull(), F.col("s")], per_task=100)
    assert [r.s for r in got.orderBy("number").collect()] == [*sorted(f"s{i}" for i in range(1000)), None]
    assert got.select("_part").distinct().count() > 5


def spark_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix_of_odd_rows(odd, empty):
    from tessera.llm.mixing import mix, mixed_rows

    rows, _ = mix(odd, block=64)
    got = rows.collect()
    assert len(got) == len(ODD) and {r["size"] for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert mixed_rows(odd).columns == odd.columns and mix(empty)[0].count() == 0
    ours = ("_size", "_taken", "_id", "_crc", "_source", "_th", "_k", "_row", "_copies", "_copy", "_words", "_chunk", "a.b")
    clash = odd.withColumns({c: F.lit(i) for i, c in enumerate(ours)})
    out = mixed_rows(clash)
    assert out.columns == clash.columns and {r["_size"] for r in out.collect()} == {0} and {r["a.b"] for r in out.collect()} == {12}
    hot = spark_rows(odd.sparkSession, [(1, "a b c", "s")] * 500 + [(2, "d e", "t")] * 3)
    assert collections.Counter((r.doc_id, r.taken) for r in mix(hot)[0].collect())[(2, 6)] == 3 and mixed_rows(hot).count() >= 400


def test_mixed_rows_cut_the_last_text(spark):
    from tessera.llm.mixing import mixed_rows

    rows = [(i, f"  a{i} b\tc  d", "s" if i < 3 else "t") for i in range(9)]
    out = mixed_rows(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=3).collect()
    n = collections.Counter()
    for r in out:
        n[r.source] += len(WORD.findall(r.text))
    assert n == {"s": 12, "t": 24} and len({r.doc_id for r in out if r.source == "t"}) == 6


@needs_data
def test_leaks_are_the_contained_items(spark, docs):
    items = duckdb.execute(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    want = {(d, i) for d, t in docs for i, x in items if x in t}
    got = {(r.doc_id, r.item_id) for r in q.op4_leaks(spark, SF).collect()}
    assert want <= got and len(got - want) <= 2


def test_leaks_with_other_numbers_and_names(spark, odd, empty, monkeypatch):
    from tessera.llm import decontaminate as de

    item = "The train leaves Paris at 5 pm with 120 passengers and after 3 hours Maria counts 90 kg of luggage in the last car."
    other = "He said the train leaves Rome at 7 pm with 240 passengers and after 4 hours Anna counts 80 kg of luggage in the last car!"
    equal = other.replace("after 4 hours", "after 7 hours")  # two numbers that differed are equal now
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short"), (None, item), (4, "apples and red pears")], "item_id long, text string")
    rows = spark.createDataFrame([(1, f"x y. {item} z"), (2, other), (3, equal), (4, "nothing of the kind here at all"), (5, None), (6, "I like apples and red pears.")], "doc_id long, text string")
    for size in (1 << 20, 1):
        monkeypatch.setattr(de, "BLOCK_BYTES", size)
        got = {(r.doc_id, r.item_id, r.kind) for r in de.find_leaks(rows, bench).collect()}
        assert got == {(1, 1, "exact"), (2, 1, "reparameterised"), (3, 1, "reparameterised"), (6, 4, "exact")}
    assert de.drop_leaks(odd, bench).count() == len(ODD) and de.drop_leaks(odd, bench.filter("false")).columns == odd.columns and de.find_leaks(empty, bench).count() == 0


NAMES = "Maria Anna Tom Peter Olga Ravi Chen Lucy Omar Nina Hugo Ella".split()
THINGS = "apples marbles tickets bottles stamps pencils crates chairs plates shells coins lamps bricks candles baskets ropes".split()
PLACES = "market harbour library school garden station bakery workshop museum stadium theatre farm".split()
ASKED = (
    "{a} buys {m} {x} at the {p} and gives {n} of the {x} to {b} before lunch. Then {a} loses {k} more {x} on the way home. How many {x} are left?",
    "On Monday {a} carried {m} kg of {x} to the {p}, and {b} carried {n} kg of {y} back. The trip took {k} hours. What was the total weight of {x} and {y}?",
    "{a} and {b} share {m} {x} in the {p}. If {a} takes {n} {x} first and the rest is put into {k} equal boxes of {y}, how many does each box hold?",
    "A {p} sells {x} for {m} dollars and {y} for {n} dollars each. {a} pays with a note of {k} dollars for {b}. How much change does {a} get from the {p}?",
)


def problem(rng, fixed):
    """A word problem whose numbers and names are drawn anew, whose things and place are not."""
    form, x, y, p = fixed
    a, b = rng.sample(NAMES, 2)
    return form.format(a=a, b=b, x=x, y=y, p=p, m=rng.randint(2, 9), n=rng.randint(2, 9), k=rng.randint(2, 9))


def test_leaks_of_redrawn_problems_recall_and_precision():
    from tessera.llm import decontaminate as de

    rng = random.Random(12)
    every = [(f, x, y, p) for f in ASKED for x in THINGS for y in THINGS for p in PLACES if x != y]
    chosen = rng.sample(every, 300)
    items = de.Items.of(list(range(300)), [problem(rng, c) for c in chosen])
    lead = "Some notes from today follow here without any order."
    redrawn = [f"{lead} {problem(rng, c)} And so on." for c in chosen]
    found = de.matches(items, [x.encode() for x in redrawn])
    assert sum(i in [m[0] for m in found.get(i, ())] for i in range(300)) / 300 >= 0.95
    # Other forms about the same things hold no item.
    clean = [f"{lead} In the {p} there were {x} and {y} for sale, {m} of one kind and {n} of the other, said {a} to the man who asked how many {x} were left." for _, x, y, p in chosen for m, n, a in [(rng.randint(2, 9), rng.randint(2, 9), rng.choice(NAMES))]]
    assert not de.matches(items, [x.encode() for x in clean])


def test_leaks_check_repeated_names():
    from tessera.llm import decontaminate as de

    item = "Yesterday the teacher told us that Maria had 4 red balls while our friend Maria wanted 6 and that poor Maria lost 2."
    items = de.Items.of([1], [item])
    same = item.replace("Maria", "Olga").replace("4", "7")
    mixed = item.replace("Maria", "Olga", 1).replace("Maria", "Ravi", 1).replace("Maria", "Nina", 1)
    assert de.matches(items, [same.encode()])[0][0][:2] == (1, "reparameterised") and not de.matches(items, [mixed.encode()])


def test_leaks_of_a_large_benchmark_hold_one_block_at_a_time(spark, monkeypatch):
    """Over 4 MB of items: blocks of the stated size, one broadcast at a time, results of all."""
    from tessera.llm import decontaminate as de

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts = [" ".join(word() for _ in range(60)) for _ in range(11_000)]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").repartition(4)
    sizes, live, shared = [], [0], de.share

    def counted(session, block):
        get = shared(session, block)
        sizes.append(sum(len(texts[i]) for i in block.ids))
        live[0] += 1
        assert live[0] == 1
        destroy = get.sent.destroy
        get.sent.destroy = lambda: (destroy(), live.__setitem__(0, live[0] - 1))
        return get

    monkeypatch.setattr(de, "share", counted)
    docs = spark.createDataFrame([(i, f"so {texts[i]} ok") for i in (0, 5000, 10_999)] + [(7, "no item")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in de.find_leaks(docs, bench).collect()} == {(i, i) for i in (0, 5000, 10_999)}
    assert len(sizes) >= 2 and max(sizes) <= de.BLOCK_BYTES and sum(sizes) > de.BLOCK_BYTES
    assert [r.doc_id for r in de.drop_leaks(docs, bench).collect()] == [7]


def test_leaks_in_capitals(spark):
    from tessera.llm import decontaminate as de

    item = "L'été dernier, a good friend of Éonleeau and I walked à côté de la rivière with 12 dogs, où Ségolène dormait."
    other = item.upper().replace("12", "15").replace("SÉGOLÈNE", "ÉLÉONORE")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = spark.createDataFrame([(1, f"x {item.upper()} y"), (2, item.lower()), (3, other)], "doc_id long, text string")
    got = {r.doc_id: (r.kind, r.covered) for r in de.find_leaks(rows, bench).collect()}
    assert got[1] == got[2] == ("exact", 1.0) and 3 in got
    assert (de.Template(["so ÉONLEEAU ÉTAIT là".encode()]).kind == de.LITERAL).all()


def test_leaks_of_items_with_few_literal_words(spark):
    from tessera.llm import decontaminate as de

    short, long = "Compute 12 x 7 - 3 + 15 / 5", "Add 1 2 3 4 5 6 7 8 9 10 11 12 13 14"
    bench = spark.createDataFrame([(1, short), (2, long)], "item_id long, text string")
    texts = [f"now {short}, please", f"see {long} and so on", short.replace("12", "13"), "Add 14 13 12 11 10 9 8 7 6 5 4 3 2 1"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.kind) for r in de.find_leaks(rows, bench).collect()} == {(0, 1, "exact"), (1, 2, "exact")}


def test_licenses(spark, odd, empty):
    from tessera.llm.licenses import scan_licenses

    filler = " ".join(f"w{i}" for i in range(300))
    rows = [(1, f"{filler}. Licensed under the Apache License, Version 2.0. {filler}"), (2, f"released under the MIT license. {filler} Released under the MIT License"), (3, filler), (4, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."), (5, "Licensed under the MIT License")]
    got = collections.Counter((r.doc_id, r.license) for r in scan_licenses(spark.createDataFrame([*rows, rows[4]], "doc_id long, text string")).collect())
    assert got == {(1, "Apache-2.0"): 1, (2, "MIT"): 2, (4, "GPL-3.0"): 1, (5, "MIT"): 2}
    assert scan_licenses(odd).count() == 0 and scan_licenses(empty).count() == 0
    assert scan_licenses(odd.withColumn("text", F.lit(rows[4][1]))).columns == ["doc_id", "license", "contained", "first_word", "end_word"]


def test_each_license_template_alone_is_itself():
    from tessera.llm.licenses import TEMPLATES, Scanner

    scanner = Scanner.of()
    got = scanner.scan([x.encode() for _, x in TEMPLATES])
    assert len({n for n, _ in TEMPLATES}) >= 30
    for i, (name, text) in enumerate(TEMPLATES):
        assert [x[0] for x in got[i]] == [name], (name, text, got[i])


def brute_licenses(texts, templates):
    """(text, license) of every template that some window of twice its length holds to 75 %, without MinHash."""
    grams = lambda x: [tuple(y) for y in zip(*[[w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in WORD.findall(x.translate(LOWER)) if w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")][i:] for i in range(5)], strict=False)]
    out = set()
    for d, text in enumerate(texts):
        g = grams(text)
        for name, template in templates:
            t = set(grams(template))
            at = [i for i, x in enumerate(g) if x in t]
            if any(len({g[j] for j in at if i <= j < i + len(t)}) >= 0.75 * len(t) for i in at):
                out.add((d, name))
    return out


def test_licenses_equal_brute_force_and_recall():
    from tessera.llm.licenses import TEMPLATES, Scanner

    rng = random.Random(2)
    filler = lambda n: " ".join(f"w{rng.randint(0, 999)}" for _ in range(n))
    texts, planted = [], []
    for k in range(400):
        name, template = TEMPLATES[k % len(TEMPLATES)]
        words = template.split()
        for _ in range(len(words) // 40):  # a few words are changed
            words[rng.randrange(len(words))] = "changed"
        texts.append(f"{filler(rng.randint(0, 300))} {' '.join(words)} {filler(rng.randint(0, 300))}")
        planted.append(name)
    texts += [filler(200) for _ in range(50)]
    got = Scanner.of().scan([x.encode() for x in texts])
    want = brute_licenses(texts, TEMPLATES)
    found = {(d, x[0]) for d, places in got.items() for x in places}
    assert found <= want and {d for d, _ in found} == {d for d, _ in want}
    held = [k for k in range(400) if (k, planted[k]) in want]
    assert len(held) > 300 and sum((k, planted[k]) in found for k in held) / len(held) >= 0.99


@needs_data
def test_quality_model_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in q.op1_quality(spark, sf).collect()}
    labels = duckdb.execute(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall()
    held = [(got[d].predicted, y) for d, y in labels if got[d].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.93
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 for d, r in got.items())


def test_quality_model_without_both_labels(odd, empty, spark):
    from tessera.llm.quality_model import score_documents

    labels = spark.createDataFrame([(4, 1), (5, None), (None, 0)], "doc_id long, quality int")
    assert {r.score for r in score_documents(odd, labels).collect()} == {2 / 3}
    both = spark.createDataFrame([(1, 0), (4, 1), (7, 1), (9, 0), (10, 1)], "doc_id long, quality int")
    assert score_documents(odd, both).count() == len(ODD) and score_documents(empty, both).count() == 0


@needs_data
def test_quality_vectors_alone_tell_labels_apart_and_reruns_agree(spark):
    """The pooled word vectors without the ratios reach 0.9 on held-out rows; ids that are given twice don't make reruns differ."""
    import numpy as np

    from tessera.llm import quality_model as qm
    from tessera.session import table

    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    twice = docs.unionByName(docs.filter("doc_id % 3 = 0").withColumn("text", F.lit("other words")))
    got = [{(r.doc_id, r.score) for r in qm.score_documents(twice, labels).collect()} for _ in range(2)]
    assert got[0] == got[1]
    model = qm.fit(docs, labels.filter(~qm.held_out()))
    rows = docs.join(labels, "doc_id").select("text", "quality", qm.held_out().alias("held")).collect()
    x = np.concatenate([model.features([(r.text or "").encode()]) for r in rows])[:, : qm.DIM]
    y, held = np.array([float(r.quality) for r in rows]), np.array([r.held for r in rows])
    z = np.clip((x - x[~held].mean(0)) / (x[~held].std(0) + 1e-6), -8, 8)
    w1, b1, w2, b2 = qm.train_network(z[~held], y[~held], np.ones((~held).sum()))
    assert (((np.tanh(z[held] @ w1 + b1) @ w2 + b2) > 0) == (y[held] == 1)).mean() > 0.9


@needs_data
def test_pipeline_equals_brute_force(spark):
    """Rules, near duplicates, leaks, taken words and shards of the pipeline, each held against plain Python on the stage's input."""
    import corpus_pipeline as cp
    from tessera.session import cut, table

    docs = table(spark, SF, "documents")
    good = cut(cp.quality_rules(spark, docs, SF))
    verdicts = {r.doc_id: r.kept for r in q.op9_quality_rules(spark, SF).collect()}
    assert sorted(r.doc_id for r in good.collect()) == sorted(d for d, k in verdicts.items() if k)
    one = cut(cp.near_duplicates(spark, good, SF))
    comps = brute_components([(r.doc_id, r.text) for r in good.collect()])
    assert sorted(r.doc_id for r in one.collect()) == sorted(d for d, (_, c) in comps.items() if c == d)
    clean = cut(cp.decontamination(spark, one, SF))
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    gone = {r.doc_id: r.text for r in one.join(clean, "doc_id", "left_anti").collect()}
    fold = lambda t: [w.casefold().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in WORD.findall(t)]
    grams = lambda t: set(zip(*[fold(t)[i:] for i in range(8)], strict=False))
    held = [grams(x) for x in items]
    assert not [r.doc_id for r in clean.collect() if any(x in r.text for x in items)]
    assert all(any(g & h for h in held) for g in map(grams, gone.values()))
    mixed = cut(cp.mixing(spark, clean, SF))
    sizes = collections.Counter()
    for r in clean.collect():
        sizes[r.source] += len(WORD.findall(r.text))
    order = sorted(sizes)
    want = dict(zip(order, filled([sizes[x] for x in order], [1 + i % 3 for i in range(len(order))]), strict=True))
    words = collections.Counter()
    for r in mixed.collect():
        words[r.source] += len(WORD.findall(r.text))
    assert all(abs(words[x] - want[x]) <= 1 for x in order)
    placed = cp.sharding(spark, mixed, SF).collect()
    assert len(placed) == mixed.count() and sorted(r.position for r in placed) == list(range(len(placed)))
    assert all(r.shard == r.position % cp.SHARDS and r.slot == r.position // cp.SHARDS for r in placed)


def test_pipeline_of_odd_and_empty_tables(spark, odd, tmp_path):
    import corpus_pipeline as cp

    clash = odd.withColumns({c: F.lit(1) for c in ("_size", "_taken", "_id", "_crc", "_source", "_k", "_row", "rep", "comp", "grams", "position", "shard")})
    for name, rows in (("odd", clash), ("empty", clash.filter("false"))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, None), (2, "a b c d")], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        assert cp.run(spark, f"{tmp_path}/{name}").count() == 0  # every odd row fails a rule
    kept = cp.near_duplicates(spark, clash, "")
    assert kept.columns == clash.columns and cp.mixing(spark, kept, "").columns == clash.columns
    assert cp.decontamination(spark, kept, f"{tmp_path}/odd").count() == kept.filter("NOT text <=> 'a b c d e'").count()


@needs_data
def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    from tessera.session import cut, table

    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, docs
    for k, (_, stage) in enumerate(cp.STAGES):
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = cut(stage(spark, kept, SF))
        after = [r.doc_id for r in kept.select("doc_id").collect()]
        assert set(after) <= before and after
        if k < 4:
            assert kept.columns == columns
    assert sorted(r.position for r in kept.collect()) == list(range(len(after)))
