"""Exact substring deduplication by a distributed merge sort of suffixes that knows common prefixes.

Every 200-byte string that starts twice is found, in whole texts:

1. Each window start p has an anchor, the first least hash among the 64-byte strings inside its window;
   equal windows have equal anchors at equal distance. Neighbouring windows with one anchor form a
   context: the bytes from the anchor on, and those before it.
2. Anchors are counted by a shuffle of their hashes, and those that occur twice or more go back to their
   documents by a join. The others end here: their windows can't repeat.
3. The contexts left are sorted into runs, front-coded against their predecessor, and exchanged by the
   hash of their anchor. Loser trees merge the runs; each node keeps the common prefix with the last
   winner, so known prefixes are never compared again.
4. The common prefixes of neighbours in merged order decide, exactly: two windows at distance d from their
   anchors are equal if and only if the contexts agree in 200 - d bytes from the anchor on, that is, no
   neighbour between them shares less, and in d bytes before it, which the order of the bytes before the
   anchor tells in the same way. Equal contexts are settled as soon as they meet, in the run or in the merge.
5. An anchor that occurs over HOT times, beyond what one task should hold, has its contexts split into
   single windows, which go by their own hash to the same merge; of those only windows whose hash occurs
   twice travel. Hashes route and prune; they never decide.

There is one plan for all sizes; step 5's extra pass runs if such an anchor exists.

Defined results: a null text is empty; documents never share a match across their ends; documents
under 200 bytes keep everything; equal rows are copies of each other and lose all their 200-byte
strings; ids may repeat or be null; texts are cut into segments inside, which overlap so that none
is lost; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import _TABLES, frames, keyed_join, mix64
from tessera.session import cut

LENGTH, GRAM = 200, 64
#: 64-byte strings inside a window.
REACH = LENGTH - GRAM + 1
#: Bytes of a segment of a very long text.
SEGMENT = 1 << 21
#: Occurrences of an anchor that one task may gather; contexts of a task.
HOT, PER_TASK = 200_000, 40_000
#: Bytes of contexts that a task sorts at a time.
RUN_BYTES = 8 << 20
#: Bytes of text whose anchors are found at once; a dozen arrays of eight bytes for each stand beside it.
BATCH = 1 << 20
#: Stands for a null id.
NO_ID = -(1 << 63)
#: Most bytes of a context.
_WIDTH = LENGTH + REACH - 1


class Anchors:
    """Runs of window starts with one anchor: text number, first and last start, anchor, hash of its 64 bytes.

    ``raw`` holds the texts one after the other; positions count from its start.
    """

    def __init__(self, texts: list[bytes]) -> None:
        self.raw = raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        n = len(raw) - GRAM + 1
        valid = np.zeros(max(len(raw), 1), dtype=bool)
        for a, b in zip(ends - [len(t) for t in texts], ends, strict=True):
            valid[a : max(a, b - LENGTH + 1)] = True
        starts = np.flatnonzero(valid)
        if not len(starts):
            self.text = self.first = self.last = self.anchor = np.empty(0, dtype=np.int64)
            self.gram = np.empty(0, dtype=np.uint64)
            return
        up, down = _TABLES.get(len(raw) + 1)
        self.sums = sums = np.empty(len(raw) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
        gram = mix64((sums[GRAM:] - sums[:-GRAM]) * down[:n])
        # Hash in the high bits, place in the low ones: the least value is the first of the least hashes.
        low = np.uint64(25)
        least = ((gram >> low) << low) | np.arange(n, dtype=np.uint64)
        step = 1
        while 2 * step <= REACH:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < REACH:
            least = np.minimum(least[: step - REACH], least[REACH - step :])
        anchor = (least[starts] & np.uint64((1 << 25) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1))))
        self.first = starts[new]
        self.last = starts[np.concatenate((new[1:], [len(starts)])) - 1]
        self.anchor = anchor[new]
        self.text = np.searchsorted(ends, self.first, side="right")
        self.gram = gram[self.anchor]

    def starts(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(run, start) of every window of the runs ``at``."""
        count = self.last[at] - self.first[at] + 1
        return np.repeat(at, count), np.arange(count.sum()) + np.repeat(self.first[at] - np.cumsum(count) + count, count)

    def prints(self, starts: np.ndarray) -> np.ndarray:
        """Hashes of the windows that start at ``starts``."""
        return mix64((self.sums[starts + LENGTH] - self.sums[starts]) * _TABLES.get(len(self.raw) + 1)[1][starts])


def pieces(frame: pd.DataFrame, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """(ids, text hashes, byte offsets, texts), with very long texts cut into segments that overlap by LENGTH - 1."""
    ids, hashes = frame["id"].to_numpy(dtype=np.int64), frame["th"].to_numpy(dtype=np.int64)
    if sum(map(len, texts)) <= SEGMENT:
        yield ids, hashes, np.zeros(len(ids), dtype=np.int64), texts
        return
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - LENGTH + 1), SEGMENT):
            yield ids[i : i + 1], hashes[i : i + 1], np.array([a]), [t[a : a + SEGMENT + LENGTH - 1]]


def _counted(ids: np.ndarray, hashes: np.ndarray, text: np.ndarray, keys: np.ndarray) -> pd.DataFrame:
    """Rows (id, th, key, n): how often each text has each key."""
    order = np.lexsort((keys, text))
    t, k = text[order], keys[order]
    new = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])))) if len(t) else np.empty(0, dtype=np.int64)
    return pd.DataFrame({"id": ids[t[new]], "th": hashes[t[new]], "key": k[new].view(np.int64), "n": np.diff(np.concatenate((new, [len(t)])))})


def _own_anchors(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame, texts in frames(rows, "text", BATCH):
        for ids, hashes, _, part in pieces(frame, texts):
            x = Anchors(part)
            yield _counted(ids, hashes, x.text, x.gram)


def _own_windows(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The windows of hot anchors."""
    for frame, texts in frames(rows, "text", BATCH):
        busy = _union(frame["hot"])
        for ids, hashes, _, part in pieces(frame, texts):
            x = Anchors(part)
            run, start = x.starts(np.flatnonzero(_in(busy, x.gram)))
            yield _counted(ids, hashes, x.text[run], x.prints(start) if len(start) else np.empty(0, dtype=np.uint64))


def _union(lists: pd.Series) -> np.ndarray:
    """The distinct values of a column of arrays of longs, sorted, as unsigned."""
    some = [np.asarray(x, dtype=np.int64) for x in lists if x is not None]
    return np.unique(np.concatenate(some).view(np.uint64)) if some else np.empty(0, dtype=np.uint64)


def _in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), dtype=bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def front_coded(keys: list[bytes]) -> tuple[np.ndarray, bytes]:
    """Common prefix of each of the sorted keys with the one before, and the rests in a row."""
    grid = np.zeros((len(keys), _WIDTH), dtype=np.uint8)
    for i, k in enumerate(keys):
        grid[i, : len(k)] = np.frombuffer(k, dtype=np.uint8)
    size = np.array([len(k) for k in keys])
    common = np.zeros(len(keys), dtype=np.int64)
    if len(keys) > 1:
        differs = grid[1:] != grid[:-1]
        at = np.where(differs.any(axis=1), differs.argmax(axis=1), _WIDTH)
        common[1:] = np.minimum(at, np.minimum(size[1:], size[:-1]))
    return common, b"".join(k[c:] for k, c in zip(keys, common.tolist(), strict=True))


#: What a run holds besides its keys: id, text hash, first start, bytes before the anchor, whether all windows are known to repeat.
_FIELDS = 5


def pack(keys: list[bytes], meta: np.ndarray) -> bytes:
    """A sorted, front-coded run of keys with their rows of ``meta`` (n, _FIELDS)."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    keys = [keys[i] for i in order]
    common, rests = front_coded(keys)
    size = np.array([len(k) for k in keys])
    return b"".join([np.int64(len(keys)).tobytes(), common.astype(np.uint16).tobytes(), size.astype(np.uint16).tobytes(), np.ascontiguousarray(meta[order]).astype(np.int64).tobytes(), rests])


def unpack(blob: bytes) -> Iterator[tuple[bytes, int, tuple]]:
    """(key, common prefix with the one before, meta) in order."""
    n = int(np.frombuffer(blob, dtype=np.int64, count=1)[0])
    at = 8
    common = np.frombuffer(blob, dtype=np.uint16, count=n, offset=at).tolist()
    size = np.frombuffer(blob, dtype=np.uint16, count=n, offset=at + 2 * n).tolist()
    meta = np.frombuffer(blob, dtype=np.int64, count=n * _FIELDS, offset=at + 4 * n).reshape(n, _FIELDS).tolist()
    at += 4 * n + 8 * n * _FIELDS
    key = b""
    for c, s, m in zip(common, size, meta, strict=True):
        key = key[:c] + blob[at : at + s - c]
        at += s - c
        yield key, c, m


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two keys that agree in ``known`` bytes."""
    most, step = min(len(a), len(b)), 16
    while known + step <= most and a[known : known + step] == b[known : known + step]:
        known += step
        step *= 2
    while step > 1:
        step //= 2
        if known + step <= most and a[known : known + step] == b[known : known + step]:
            known += step
    return known + (known < most and a[known] == b[known])


def merged(runs: list[Iterator]) -> Iterator[tuple[bytes, int, list]]:
    """Merges sorted runs of (key, common, meta); yields (key, common prefix with the last one yielded, meta).

    A loser tree over the runs. ``common[r]`` is the prefix that the key at hand of run r shares with the
    last winner that it met, so of two contestants the one that shares more comes first without a look at
    bytes, and with equal shares bytes are compared from there on only.
    """
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    key: list = [None] * leaves
    common, meta, loser = [-1] * leaves, [None] * leaves, [0] * leaves

    def advance(r: int, first: bool = False) -> None:
        got = next(runs[r], None) if r < len(runs) else None
        if got is None:
            key[r], common[r] = None, -1
        else:
            key[r], common[r], meta[r] = got
            if first:
                common[r] = 0

    def match(r: int, s: int) -> tuple[int, int]:
        """(winner, loser) of two runs."""
        a, b = common[r], common[s]
        if a != b:
            return (r, s) if a > b else (s, r)
        if a < 0:
            return r, s
        x, y = key[r], key[s]
        at = common_prefix(x, y, a)
        if x[at : at + 1] <= y[at : at + 1]:
            common[s] = at
            return r, s
        common[r] = at
        return s, r

    for r in range(leaves):
        advance(r, True)
    up = list(range(leaves))
    level = leaves
    while level > 1:
        level //= 2
        up2 = []
        for i in range(level):
            w, lost = match(up[2 * i], up[2 * i + 1])
            loser[level + i] = lost
            up2.append(w)
        up = up2
    w = up[0]
    while key[w] is not None:
        yield key[w], common[w], meta[w]
        advance(w)
        node = (w + leaves) // 2
        while node:
            w, loser[node] = match(w, loser[node])
            node //= 2


def repeated_windows(keys: list[bytes], common: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of contexts in merged order occur twice, one context after the other, and how many each has.

    ``common`` holds each key's common prefix with the one before. At distance d from the anchor, contexts fall into
    classes where neighbours share 200 - d bytes from the anchor on, and where neighbours in the order of the bytes
    before it share d of those; windows are equal where both classes are.
    """
    n, back = len(keys), meta[:, 3]
    low = LENGTH - (np.array([len(k) for k in keys]) - back)
    count = back - low + 1
    begin = np.cumsum(count) - count
    flags = np.repeat(meta[:, 4] == 1, count)
    left = [k[len(k) - b :] for k, b in zip(keys, back.tolist(), strict=True)]
    order = np.array(sorted(range(n), key=left.__getitem__))
    grid = np.frombuffer(b"".join([left[i].ljust(REACH, b"\0") for i in order]), dtype=np.uint8).reshape(n, REACH)
    shared, rank = np.zeros(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    differs = grid[1:] != grid[:-1]
    size = back[order]
    shared[1:] = np.minimum(np.where(differs.any(axis=1), differs.argmax(axis=1), REACH), np.minimum(size[1:], size[:-1]))
    bits = int(n).bit_length()
    for d in range(int(low.min()), int(back.max()) + 1):
        on = np.flatnonzero((low <= d) & (d <= back))
        if len(on) < 2:
            continue
        pair = np.cumsum(common < LENGTH - d)[on] * (n + 1) + np.cumsum(shared < d)[rank[on]]
        v = np.sort((pair << bits) | on)
        same = (v[1:] >> bits) == (v[:-1] >> bits)
        hit = v[np.concatenate((same, [False])) | np.concatenate(([False], same))] & ((1 << bits) - 1)
        flags[begin[hit] + back[hit] - d] = True
    return flags, count


def spans_of(flags: np.ndarray, count: np.ndarray, ids: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> pd.DataFrame:
    """Byte ranges of the flagged windows of each context; windows of context i start at first[i] and on."""
    gap = np.zeros(len(flags) + len(count), dtype=np.int8)
    owner = np.repeat(np.arange(len(count)), count)
    gap[np.arange(len(flags)) + owner] = flags  # a zero closes each context
    edge = np.flatnonzero(np.diff(gap, prepend=0, append=0))
    lo, hi = edge[::2], edge[1::2]
    starts = np.concatenate(([0], np.cumsum(count + 1)))
    own = np.searchsorted(starts, lo, side="right") - 1
    at = first[own] - starts[own]
    return pd.DataFrame({"id": ids[own], "th": hashes[own], "a": lo + at, "b": hi - 1 + at + LENGTH})


_RUN = "task long, kind int, blob binary"
_SPAN = "id long, th long, a long, b long"


def _last_end(key: bytes, m: list) -> int:
    """Where a context's last window ends."""
    return m[2] + len(key)


def _runs(n_tasks: int):
    """Sorted runs of contexts (kind 1) and spans that are settled already (kind 0), each with its task."""

    def emit(held: dict) -> Iterator[tuple]:
        for task, (keys, meta) in held.items():
            keep, spans, seen = [], [], {}
            for i, (k, m) in enumerate(zip(keys, meta, strict=True)):
                j = seen.setdefault((k, m[3]), i)
                if j == i:
                    keep.append(i)
                else:
                    meta[j][4] = 1
                    spans.append((m[0], m[1], m[2], _last_end(k, m)))
            yield task, 1, pack([keys[i] for i in keep], np.array([meta[i] for i in keep], dtype=np.int64))
            if spans:
                yield task, 0, np.array(spans, dtype=np.int64).tobytes()

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = {}, 0
        for frame, texts in frames(rows, "text", BATCH):
            known, busy, windows = (_union(frame[c]) for c in ("grams", "hot", "windows"))
            for ids, hashes, offset, part in pieces(frame, texts):
                x = Anchors(part)
                at = np.flatnonzero(_in(known, x.gram))
                begin = np.concatenate(([0], np.cumsum([len(t) for t in part])))
                raw = x.raw.tobytes()
                heat = _in(busy, x.gram[at])
                plain = at[~heat]
                single, start = x.starts(at[heat])
                if len(single):
                    prints = x.prints(start)
                    some = _in(windows, prints)
                    single, start, prints = single[some], start[some], prints[some]
                else:
                    prints = np.empty(0, dtype=np.uint64)
                lo, mid, hi = (np.concatenate(v) for v in ((x.first[plain], start), (x.anchor[plain], start), (x.last[plain] + LENGTH, start + LENGTH)))
                own = x.text[np.concatenate((plain, single))]
                tasks = (np.concatenate((x.gram[plain], prints)) % np.uint64(n_tasks)).astype(np.int64)
                meta = np.stack([ids[own], hashes[own], lo - begin[own] + offset[own], mid - lo, np.zeros(len(own), dtype=np.int64)], axis=1)
                for task, a, m, b, row in zip(tasks.tolist(), lo.tolist(), mid.tolist(), hi.tolist(), meta.tolist(), strict=True):
                    keys, rest = held.setdefault(task, ([], []))
                    keys.append(raw[m:b] + raw[a:m][::-1])
                    rest.append(row)
                size += int((hi - lo).sum())
                if size > RUN_BYTES:
                    yield pd.DataFrame(list(emit(held)), columns=["task", "kind", "blob"])
                    held, size = {}, 0
        yield pd.DataFrame(list(emit(held)), columns=["task", "kind", "blob"]).astype({"task": "int64", "kind": "int32"})

    return run


def settled(entries: Iterator[tuple[bytes, int, list]]) -> Iterator[pd.DataFrame]:
    """Spans of the windows that occur twice among contexts in merged order (key, common prefix with the one before, meta)."""
    keys, commons, meta, copies = [], [], [], []

    def done() -> pd.DataFrame:
        m = np.array(meta, dtype=np.int64)
        flags, count = repeated_windows(keys, np.array(commons), m)
        out = spans_of(flags, count, m[:, 0], m[:, 1], m[:, 2])
        return pd.concat([out, pd.DataFrame(copies, columns=["id", "th", "a", "b"])]) if copies else out

    for key, common, m in entries:
        if keys and common == len(key) == len(keys[-1]) and m[3] == meta[-1][3]:  # an equal context
            meta[-1][4] = 1
            copies.append((m[0], m[1], m[2], _last_end(key, m)))
            if m[4] or len(copies) < PER_TASK:
                continue
            yield pd.DataFrame(copies, columns=["id", "th", "a", "b"])
            copies = []
            continue
        if common < GRAM and len(keys) >= PER_TASK // 2:
            yield done()
            keys, commons, meta, copies = [], [], [], []
        keys.append(key)
        commons.append(common)
        meta.append(m)
    if keys:
        yield done()


def _merge_task(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (task, kind): passes settled spans on and merges each task's runs."""
    task, runs = None, []
    for frame in rows:
        for t, kind, blob in zip(frame["task"], frame["kind"], frame["blob"], strict=True):
            if t != task:
                yield from settled(merged([unpack(b) for b in runs]))
                task, runs = t, []
            if kind == 0:
                yield pd.DataFrame(np.frombuffer(blob, dtype=np.int64).reshape(-1, 4), columns=["id", "th", "a", "b"])
            else:
                runs.append(blob)
    yield from settled(merged([unpack(b) for b in runs]))


def _repeated(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """own: (id, th, key, n). The keys that occur twice or more (key, total), and their rows of ``own``."""
    own = cut(own)
    counts = cut(own.groupBy("key").agg(F.sum("n").alias("total")).filter("total > 1"))
    return counts, keyed_join(own, counts, "key", "total").select("id", "th", "key", "total")


def repeated_spans(named: DataFrame, hot: int = HOT) -> DataFrame:
    """named: (id, th, text, ...). Rows (id, th, a, b): byte ranges that repeated windows cover; ranges may overlap."""
    texts = named.select("id", "th", "text")
    counts, rows = _repeated(texts.mapInPandas(_own_anchors, "id long, th long, key long, n long"))
    wanted = rows.groupBy("id", "th").agg(F.collect_set("key").alias("grams"), F.collect_set(F.when(F.col("total") > hot, F.col("key"))).alias("hot"))
    n = counts.agg(F.coalesce(F.sum(F.when(F.col("total") <= hot, F.col("total"))), F.lit(0)).alias("n"), F.count_if(F.col("total") > hot).alias("h")).first()
    size, windows = n["n"], F.lit(None).cast("array<bigint>").alias("windows")
    held = named.join(wanted, ["id", "th"])
    if n["h"]:
        again = texts.join(wanted.filter(F.size("hot") > 0).select("id", "th", "hot"), ["id", "th"])
        known, found = _repeated(again.mapInPandas(_own_windows, "id long, th long, key long, n long"))
        size += known.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first()["n"]
        held, windows = held.join(found.groupBy("id", "th").agg(F.collect_set("key").alias("windows")), ["id", "th"], "left"), "windows"
    n_tasks = int(1 + size // PER_TASK)
    # All columns of ``named`` go along, so that the shuffle of its texts is the one that remove_repeats joins by, made once.
    runs = held.select(*named.columns, "grams", "hot", windows).mapInPandas(_runs(n_tasks), _RUN)
    return runs.repartitionById(n_tasks, F.col("task").cast("int")).sortWithinPartitions("task", "kind").mapInPandas(_merge_task, _SPAN)


def union_of(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that the ranges cover; ranges that touch make one run."""
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
    return a[new], b[np.concatenate((new[1:], [len(a)])) - 1]


def _cut_out(keep_bytes: bool):
    def cut_out(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, texts in frames(rows, "text"):
            out = []
            for text, lo, hi in zip(texts, frame["lo"], frame["hi"], strict=True):
                a, b = union_of(np.asarray(lo), np.asarray(hi)) if lo is not None and len(lo) else ((), ())
                edges = [0, *(int(v) for ab in zip(a, b, strict=True) for v in ab), len(text)]
                rest = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(text), len(text) - len(rest), len(a), hashlib.sha256(rest).hexdigest(), rest if keep_bytes else None))
            columns = {c: [x[i] for x in out] for i, c in enumerate(("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"))}
            yield pd.DataFrame({"id": frame["id"].to_numpy(), "null_id": frame["null_id"].to_numpy()} | columns)

    return cut_out


_RESULT = "id long, null_id boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = True, hot: int = HOT) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, the remaining bytes as ``kept``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID).cast("long")).alias("id"), F.col(id_col).isNull().alias("null_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    # A text's ranges are about one for each anchor, so a small part of the text's own size; rows that agree share them.
    per = repeated_spans(named, hot).groupBy("id", "th").agg(F.collect_set(F.struct("a", "b")).alias("_s"))
    ranges = per.select("id", "th", F.col("_s.a").alias("lo"), F.col("_s.b").alias("hi"))
    out = named.join(ranges, ["id", "th"], "left").select("id", "null_id", "text", "lo", "hi").mapInPandas(_cut_out(keep_bytes), _RESULT)
    fields = ("n_bytes", "n_removed", "n_spans", "kept_sha256", *(("kept",) if keep_bytes else ()))
    return out.select(F.when(~F.col("null_id"), F.col("id")).alias(id_col), *fields)
