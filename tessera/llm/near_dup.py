"""Near-duplicates by SetSketch registers: banded retrieval, joint likelihood, then exact sets.

A document's set holds its distinct five-word shingles (64-bit hashes, A-Z lower-cased). Each
register is the truncated, exponentially spaced minimum of exponential variables over the set, so
registers of parts merge by maximum and agree the likelier, the more alike two sets are.

1. Documents with equal sets form a class, shown from here on by its smallest id.
2. Bands of four registers put classes into buckets. In each bucket every class meets one centre, so
   pairs inside a bucket are never all listed; each class is confirmed with the centre that it shares
   most bands with, on full sets, and confirmed links are joined to components.
3. Buckets whose classes lie in one component, nearly all, are done. In the others the classes outside
   the largest component are held against the rest of the bucket: first their registers alone, by the
   likelihood estimate, which marks the classes that have a likely partner; then the full sets of the
   marked ones. Both in blocks, so a bucket of any size is spread. A pair is looked at in the first band
   that it shares, and two classes that are joined already cost nothing. No candidate is left out, and
   texts travel only for classes that have a likely partner.

With 44 bands of 4 registers a pair at similarity 0.75 shares no band with a chance of 5.4e-8; an
estimate from 176 registers lies below ESTIMATE for such a pair with a chance of 1e-8 at most. So a
pair is missed with a chance below 1e-7 in all. Two unrelated sets at similarity 0.2 meet in some band
with a chance of 0.07, at 0.1 with 0.004. Shingles are compared by their 64-bit hashes: two sets of
together n shingles hold a false common one with a chance below n * n / 2^65.

Defined results: null and empty texts have no shingles and link with nothing; equal rows fall into
one class; rows whose id is null get no component and are not kept; an empty table gives no rows;
texts are read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import frames, keyed_join, mix64, shingle_sets
from tessera.operators.graph import connected_components
from tessera.session import cut

SHINGLE = 5
BANDS, ROWS = 44, 4
M = BANDS * ROWS
#: SetSketch parameters: base, rate, bits of a register and its largest value.
BASE, RATE, BITS = 1.002, 20.0, 14
TOP = (1 << BITS) - 2
#: Similarity asked for, in hundredths, and the estimate under which pairs outside a star aren't confirmed.
PERCENT, ESTIMATE = 75, 0.54
#: Sets that meet one centre in a task; rows of a block in step 3.
STAR, BLOCK = 256, 1024
_MUL = mix64(np.arange(1, M + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_ADD = mix64(np.arange(1001, M + 1001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LN = np.log(BASE)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The M registers of a set of distinct hashes.

    Minima are taken over hashed integers; the exponential transform is monotone and applied to the
    minima alone.
    """
    least = np.full(M, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 256):
        part = _MUL[:, None] * hashes[None, i : i + 256]
        part += _ADD[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 1) / 2.0**64 * (1 - 2**-53)) / RATE
    return np.clip(np.floor(1 - np.log(x) / _LN), 0, TOP + 1).astype(np.int64)


def band_keys(k: np.ndarray) -> np.ndarray:
    """One integer for each band; it holds the band's number and registers, so equal keys are equal bands."""
    out = np.arange(BANDS, dtype=np.int64)
    for row in k.reshape(BANDS, ROWS).T:
        out = (out << BITS) | row
    return out


def unband(keys: np.ndarray) -> np.ndarray:
    """Registers (rows, M) from band keys (rows, BANDS)."""
    return np.stack([(keys >> (BITS * i)) & ((1 << BITS) - 1) for i in reversed(range(ROWS))], axis=-1).reshape(len(keys), M)


def joint_estimate(n_a: np.ndarray, n_b: np.ndarray, above: np.ndarray, below: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of two sets of known sizes, from how their registers compare.

    With u = n_a / (n_a + n_b) and v = 1 - u a register is larger in a with chance u - vJ, larger in b
    with v - uJ and equal with J; the derivative of the log-likelihood is a quadratic in J.
    """
    u = n_a / (n_a + n_b)
    v = 1 - u
    m = above + below + equal
    b = equal * (u * u + v * v) + v * v * above + u * u * below
    root = np.sqrt(np.maximum(b * b - 4 * m * u * u * v * v * equal, 0))
    return (b - root) / (2 * m * u * v)


def _sketches(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame, texts in frames(rows, "text"):
        out = []
        for s in shingle_sets(texts, SHINGLE):
            if len(s):
                sums = (mix64(s).sum(dtype=np.uint64), mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                out.append((len(s), sums[0].tobytes() + sums[1].tobytes(), band_keys(registers(s))))
            else:
                out.append((0, b"", []))
        yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "n_shingles": [x[0] for x in out], "digest": [x[1] for x in out], "bands": [x[2] for x in out]})


def sketch(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_shingles, digest, bands); the digest is the same for equal sets only."""
    return docs.mapInPandas(_sketches, "doc_id long, n_shingles long, digest binary, bands array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (c, x) whose sets are alike, as links (a, b).

    A centre's text goes once to each task that holds up to about STAR of its partners.
    """
    sized = pairs.groupBy("c").agg(F.count(F.lit(1)).alias("_n"))
    salts = F.expr(f"_n div {STAR} + 1")
    salted = pairs.join(sized, "c").select("c", "x", F.pmod(F.xxhash64("x"), salts).cast("long").alias("salt"))
    centres = sized.select("c", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    t = texts.select("id", "text")
    rows = salted.join(t.withColumnRenamed("id", "x"), "x").select("c", "salt", F.lit(1).alias("kind"), "x", "text")
    heads = centres.join(t.withColumnRenamed("id", "c"), "c").select("c", "salt", F.lit(0).alias("kind"), F.col("c").alias("x"), "text")
    dealt = rows.unionByName(heads).repartition("c", "salt").sortWithinPartitions("c", "salt", "kind", "x")
    return dealt.mapInPandas(_links, "a long, b long")


def _links(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (c, salt, kind, x), a centre's own text first: the links of each centre, exactly."""
    centre, held = None, np.empty(0, dtype=np.uint64)
    for frame, texts in frames(rows, "text"):
        links = []
        for c, salt, kind, x, s in zip(frame["c"], frame["salt"], frame["kind"], frame["x"], shingle_sets(texts, SHINGLE), strict=True):
            if kind == 0:
                centre, held = (c, salt), s
            elif centre == (c, salt):
                both = len(np.intersect1d(held, s, assume_unique=True))
                if 100 * both >= PERCENT * (len(held) + len(s) - both):
                    links.append((c, x))
        yield pd.DataFrame(links, columns=["a", "b"]).astype("int64")


class _Block:
    """Frames sorted by (key, block, part, kind), the queries (kind 0) of each place before the classes they meet."""

    def __init__(self) -> None:
        self.at, self.asked = None, []

    def places(self, frame: pd.DataFrame) -> Iterator[tuple[int, int, int]]:
        """(first row, first row that isn't a query, end) of each place in a frame; ``asked`` then holds its queries so far."""
        place, kind = frame[["key", "block", "part"]].to_numpy(), frame["kind"].to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]).any(axis=1), [True]))) if len(frame) else []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if self.at != tuple(place[lo]):
                self.at, self.asked = tuple(place[lo]), []
                self.opened()
            yield int(lo), int(lo + (kind[lo:hi] == 0).sum()), int(hi)

    def opened(self) -> None:
        pass


def _first_shared(key: int, mine: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of ``others`` (rows of band keys) share no band with ``mine`` before that of ``key``."""
    return ~(others[:, : key >> (BITS * ROWS)] == mine[: key >> (BITS * ROWS)]).any(axis=1)


def _likely(q: tuple, bands: np.ndarray, regs: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Estimates of a query (bands, registers, size) with others."""
    above, below = (q[1] > regs).sum(axis=1), (q[1] < regs).sum(axis=1)
    return joint_estimate(q[2], size, above, below, M - above - below)


def _mark(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The classes of each place that have a likely partner in another component."""
    state = _Block()
    for frame in rows:
        comp, rep, size = frame["comp"].to_numpy(), frame["rep"].to_numpy(), frame["n_shingles"].to_numpy().astype(np.float64)
        bands = np.stack(frame["bands"].to_numpy()) if len(frame) else np.empty((0, BANDS), dtype=np.int64)
        regs = unband(bands).astype(np.int16)
        out = []
        for lo, mid, hi in state.places(frame):
            state.asked += [(bands[i], regs[i], size[i], comp[i], rep[i]) for i in range(lo, mid)]
            hit = np.zeros(hi - mid, dtype=bool)
            for q in state.asked if hi > mid else ():
                other = np.flatnonzero(comp[mid:hi] != q[3]) + mid
                other = other[_first_shared(state.at[0], q[0], bands[other])]
                other = other[_likely(q, bands[other], regs[other], size[other]) >= ESTIMATE]
                if len(other):
                    hit[other - mid] = True
                    out.append((*state.at, 0, q[4]))
            out += [(*state.at, 1, r) for r in rep[mid:hi][hit]]
        yield pd.DataFrame(out, columns=["key", "block", "part", "kind", "rep"]).astype({"kind": "int32"}).drop_duplicates()


class _Searched(_Block):
    def opened(self) -> None:
        self.root: dict = {}

    def find(self, c: int) -> int:
        while self.root.get(c, c) != c:
            c = self.root[c]
        return c


def _search(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of the marked classes of each place, exactly; one link to a component is enough, so the likeliest come first."""
    state = _Searched()
    for frame, texts in frames(rows, "text"):
        comp, rep = frame["comp"].to_numpy(), frame["rep"].to_numpy()
        bands, sets = np.stack(frame["bands"].to_numpy()), list(shingle_sets(texts, SHINGLE))
        regs, size = unband(bands).astype(np.int16), np.array([len(x) for x in sets], dtype=np.float64)
        links = []
        for lo, mid, hi in state.places(frame):
            state.asked += [(bands[i], regs[i], size[i], comp[i], rep[i], sets[i]) for i in range(lo, mid)]
            names, which = np.unique(comp[mid:hi], return_inverse=True)
            for q in state.asked if hi > mid else ():
                mine = state.find(q[3])
                other = np.flatnonzero(np.array([state.find(c) != mine for c in names.tolist()])[which]) + mid
                other = other[_first_shared(state.at[0], q[0], bands[other])]
                likely = _likely(q, bands[other], regs[other], size[other])
                order = np.argsort(-likely, kind="stable")
                for j in other[order[: int((likely >= ESTIMATE).sum())]].tolist():
                    theirs = state.find(comp[j])
                    if theirs == mine:
                        continue
                    both = len(np.intersect1d(q[5], sets[j], assume_unique=True))
                    if 100 * both >= PERCENT * (len(q[5]) + len(sets[j]) - both):
                        links.append((q[4], rep[j]))
                        state.root[mine] = theirs
                        mine = theirs
        yield pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def search_buckets(members: DataFrame, classes: DataFrame, comps: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between components inside buckets.

    members: (key, rep), the classes of every shared bucket; comps: (node, component) of the links known.
    """
    known = comps.select(F.col("node").alias("rep"), F.col("component"))
    m = members.join(known, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    sizes = m.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("_size"))
    per = sizes.groupBy("key").agg(F.max(F.struct("_size", "comp")).alias("_m"), F.count(F.lit(1)).alias("_k"), F.sum("_size").alias("n")).filter("_k > 1")
    blocks, parts = F.expr(f"(n - _m._size) div {BLOCK} + 1"), F.expr(f"n div {2 * BLOCK} + 1")
    per = cut(per.select("key", "n", F.col("_m.comp").alias("_top"), blocks.alias("_blocks"), parts.alias("_parts")))
    full = cut(keyed_join(m, per, "key", "n").join(classes, "rep").select("key", "rep", "comp", "n_shingles", "bands", "_top", "_blocks", "_parts"))
    own_block, own_part = F.pmod(F.xxhash64("rep"), F.col("_blocks")), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("_parts"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rest = ("rep", "comp", "n_shingles", "bands")
    queries = full.filter("comp <> _top").select("key", own_block.alias("block"), each("_parts").alias("part"), F.lit(0).alias("kind"), *rest)
    others = full.select("key", each("_blocks").alias("block"), own_part.alias("part"), F.lit(1).alias("kind"), *rest)
    place = ("key", "block", "part")
    dealt = queries.unionByName(others).repartition(*place).sortWithinPartitions(*place, "kind")
    marked = cut(dealt.mapInPandas(_mark, "key long, block long, part long, kind int, rep long").distinct())
    facts = full.select(*rest).dropDuplicates(["rep"]).join(texts.withColumnRenamed("id", "rep"), "rep")
    return marked.join(facts, "rep").repartition(*place).sortWithinPartitions(*place, "kind").mapInPandas(_search, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id (smallest id reachable over links) and kept."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    s = cut(sketch(d))
    some = s.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")))
    bands = classes.select("rep", F.explode("bands").alias("key"))
    shared = cut(bands.groupBy("key").agg(F.min("rep").alias("c"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = cut(keyed_join(bands, shared, "key", "n").select("key", "rep", "c"))
    met = members.filter("c <> rep").groupBy("c", "rep").agg(F.count(F.lit(1)).alias("_n"))
    # Of a class's centres, the one it shares most bands with comes first; the rest is left to step 3.
    first = cut(met.groupBy(F.col("rep").alias("x")).agg(F.max(F.struct("_n", (-F.col("c")).alias("_c"))).alias("_m")).select((-F.col("_m._c")).alias("c"), "x"))
    texts = d.withColumnRenamed("doc_id", "id").join(members.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    texts = cut(texts.dropDuplicates(["id"]))
    links = cut(confirmed(first, texts))
    comps = cut(connected_components(links))
    more = cut(search_buckets(members.select("key", "rep"), classes.drop("digest"), comps, texts))
    if not more.isEmpty():
        comps = cut(connected_components(links.unionByName(more)))
    least = classes.select("digest", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = s.select("doc_id", "n_shingles", "digest").join(least, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all its columns; of equal ids one row is kept, rows without an id stay."""
    kept = near_duplicates(docs, id_col, text_col).filter("kept").select(F.col(id_col)).distinct()
    return docs.join(kept, id_col, "left_semi").dropDuplicates([id_col]).unionByName(docs.filter(F.col(id_col).isNull())).select(*[F.col(f"`{c}`") for c in docs.columns])
