"""Benchmark decontamination by template windows.

Texts and benchmark items are made templates: numbers, names and units become typed placeholders,
other words are case-folded (all letters) without outer punctuation. A capitalised word at the start of
a sentence may be a name or not, so windows that hold one are made both ways. Windows of eight template
words are joined by hash and hits are aligned. Beside them the windows of the plain case-folded words are
joined, so that a copy of the same words is found whatever its case, which decides what is a name. A
question that was given other numbers or names is found as ``reparameterised``, an unchanged one as
``exact``.

Slots are checked by variables: an item's name, or a number of three digits or more, that fills several
slots is one variable, and in a re-parameterised question all its slots hold one new value. Over all
variables of an alignment at least half of the slots must hold their variable's commonest value, else
only windows without placeholders count. Different values may become equal and short numbers may differ
where they were equal, as redrawn numbers do.

The benchmark is read in blocks of at most BLOCK_BYTES of text, one at a time: each block is broadcast,
its result is written, and the broadcast is given up before the next one. So what driver and executors
hold has a fixed size; a benchmark of any size takes more passes over the texts.

Template windows with under half literal words would match anything, so they aren't used; the plain
windows of every item of MIN_WORDS words are, so an item of numbers or names is found word for word.

Defined results: null and empty texts match nothing; items under MIN_WORDS words are never matched;
items under eight words are one window of their own length; equal items are each reported; items
without an id are left out; texts are read whole; repeated rows have repeated results; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import Words, batches, mix64, rolled, share
from tessera.session import cut

WINDOW, MIN_WORDS = 8, 3
#: Part of an item's words that must be covered, and words in one run that count at any coverage.
COVERED, RUN = 0.5, 13
BLOCK_BYTES = 4 << 20
#: Hits that are aligned at once, and digits of a number that is a variable.
HITS, VARIABLE = 2_000_000, 3
#: Words for units; after a number they are placeholders.
UNITS = (
    "mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres "
    "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ton tons ml cl dl l liter liters litre litres gallon gallons "
    "ms s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years "
    "k c f percent usd eur gbp dollar dollars euro euros cent cents mol mmol pa kpa bar atm j kj cal kcal w kw kwh v a hz khz mhz ghz"
).split()
LITERAL, NUMBER, NAME, UNIT = range(4)
#: Kinds of windows: with placeholders, with those at sentence starts too, of plain words.
TYPED, STARTS, PLAIN = range(3)
_TYPE_HASH = mix64(np.array([0, 11, 22, 33], dtype=np.uint64))
_DIGIT = np.zeros(256, dtype=np.int64)
_DIGIT[48:58] = 1
_NUMERIC = _DIGIT.copy()
_NUMERIC[list(b".,:/-+%")] = 1
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?:;\n\"(")] = True
#: Capital letters by code point, as bits.
_CAPITAL = np.packbits([chr(i).isupper() or chr(i).istitle() for i in range(1 << 16)])
_UNIT_HASH = np.sort(Words([u.encode() for u in UNITS], strip=True).hash)


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_values, x)
    return sorted_values[np.minimum(at, len(sorted_values) - 1)] == x


def _folded(text: bytes) -> bytes:
    """Case-folded; no fold makes or removes white space or outer punctuation, so words stay words."""
    return text if text.isascii() else text.decode("utf-8", "surrogatepass").casefold().encode("utf-8", "surrogatepass")


def _capital(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a capital letter of one to three bytes begins at each place."""
    a, b, c = (raw[np.minimum(at + i, len(raw) - 1)].astype(np.int64) for i in range(3))
    code = np.where(a < 0xC0, a, np.where(a < 0xE0, (a & 0x1F) << 6 | b & 0x3F, np.where(a < 0xF0, (a & 0x0F) << 12 | (b & 0x3F) << 6 | c & 0x3F, 0)))
    return (_CAPITAL[code >> 3] >> (7 - (code & 7)) & 1).astype(bool)


class Template:
    """Template words of some texts: ``hash`` with placeholders, ``value`` without, ``kind`` and text bounds ``first``.

    ``starts`` is ``hash`` with the capitalised words that begin sentences (``begins``) as names.
    """

    def __init__(self, texts: list[bytes]) -> None:
        w = Words(texts, strip=True)
        folded = [_folded(x) for x in texts]
        self.value, self.first = w.hash if folded == texts else Words(folded, strip=True).hash, w.first
        kind = np.zeros(len(w.hash), dtype=np.int8)
        if len(kind):
            raw = w.raw
            head = raw[w.start]
            digit = (head >= 48) & (head <= 57)
            if digit.any():
                at = np.flatnonzero(digit)
                numeric = np.array([_NUMERIC[raw[a:b]].all() for a, b in zip(w.start[at], w.end[at], strict=True)])
                # A number with its unit attached, such as 5kg, is a number as well.
                kind[at] = np.where(numeric | (w.end[at] - w.start[at] <= 12), NUMBER, LITERAL)
                unit = np.flatnonzero(kind[:-1] == NUMBER) + 1
                unit = unit[kind[unit] == LITERAL]
                kind[unit[_member(_UNIT_HASH, self.value[unit])]] = UNIT
            second = raw[np.minimum(w.start + 1, len(raw) - 1)]
            upper = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E))
            # A capital inside a sentence makes a name; words in capitals are emphasis.
            inner = np.zeros(len(kind), dtype=bool)
            inner[1:] = ~_STOP[raw[w.last[:-1] - 1]]
            inner[w.first[:-1][w.first[:-1] < len(kind)]] = False
            newline = np.concatenate(([0], np.cumsum(raw == 10)))
            inner[1:] &= newline[w.start[1:]] == newline[w.last[:-1]]
            shouted = _capital(raw, w.start + np.where(head < 0x80, 1, 2)) & (w.start + np.where(head < 0x80, 1, 2) < w.end)
            capital = upper & ~shouted & (kind == LITERAL)
            kind[capital & inner] = NAME
            self.begins = capital & ~inner
        else:
            self.begins = np.zeros(0, dtype=bool)
        self.kind = kind
        self.size = w.end - w.start
        self.hash = np.where(kind == LITERAL, self.value, _TYPE_HASH[kind])
        self.starts = np.where(self.begins, _TYPE_HASH[NAME], self.hash)
        self._begun = np.concatenate(([0], np.cumsum(self.begins)))

    def windows(self, mode: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether the window is one of ``mode``."""
        words = (self.hash, self.starts, self.value)[mode]
        h = rolled(words, k)
        at = np.arange(len(h))
        return h, (self._begun[at + k] > self._begun[at]) if mode == STARTS else np.ones(len(h), dtype=bool)


@dataclass
class Items:
    """A block of the benchmark: window hashes by (length, mode), sorted, and the items' words."""

    ids: list[int]
    template: Template
    windows: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    @staticmethod
    def of(ids: list[int], texts: list[str]) -> Items:
        t = Template([x.encode("utf-8", "surrogatepass") for x in texts])
        length = np.diff(t.first)
        item_of = np.repeat(np.arange(len(ids)), length)
        out = Items(ids, t)
        for k in sorted({min(WINDOW, int(n)) for n in length if n >= MIN_WORDS}):
            start = np.arange(max(0, len(t.hash) - k + 1))
            own = item_of[start]
            fits = (start + k <= t.first[own + 1]) & ((length[own] >= WINDOW) if k == WINDOW else (length[own] == k))
            for mode in (TYPED, STARTS, PLAIN):
                h, some = t.windows(mode, k)
                if mode != PLAIN:
                    # With placeholders, at least half of a window must be literal words, else anything would match.
                    literal = np.concatenate(([0], np.cumsum((t.kind == LITERAL) & ~(t.begins & (mode == STARTS)))))
                    some = some & (2 * (literal[start + k] - literal[start]) >= k)
                h, at = h[some & fits], start[some & fits]
                order = np.argsort(h, kind="stable")
                seen = np.zeros(1 << 16, dtype=bool)
                seen[h >> np.uint64(48)] = True
                out.windows[k, mode] = (h[order], at[order], own[at[order]], seen)
        return out


def _agrees(kind: np.ndarray, value: np.ndarray, size: np.ndarray, theirs: np.ndarray) -> bool:
    """Whether at least half of the slots that share a variable hold its commonest value in the text."""
    shared = same = 0
    slots: dict[int, list[int]] = {}
    for k, v, n, x in zip(kind.tolist(), value.tolist(), size.tolist(), theirs.tolist(), strict=True):
        if k == NAME or (k == NUMBER and n >= VARIABLE):
            slots.setdefault(v, []).append(x)
    for values in slots.values():
        if len(values) > 1:
            shared += len(values)
            most = max(values.count(v) for v in set(values))
            same += most if most > 1 else 0
    return 2 * same >= shared


def _hits(items: Items, t: Template, chunk: int, chunks: int) -> np.ndarray:
    """Rows (text, item, shift, item word, window length, mode) of equal windows, for items of one chunk, sorted."""
    out = []
    for (k, mode), (h, start, own, seen) in items.windows.items():
        if chunks > 1:
            part = own % chunks == chunk
            h, start, own = h[part], start[part], own[part]
        mine, some = t.windows(mode, k)
        at = np.flatnonzero(some & seen[mine >> np.uint64(48)]) if len(h) else np.empty(0, dtype=np.int64)
        lo = np.searchsorted(h, mine[at], "left")
        n = np.searchsorted(h, mine[at], "right") - lo
        text = np.searchsorted(t.first, at, side="right") - 1
        n[at + k > t.first[text + 1]] = 0
        j = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
        p, d = np.repeat(at, n), np.repeat(text, n)
        out.append(np.stack([d, own[j], p - start[j], start[j], np.full(len(j), k), np.full(len(j), mode)], axis=1))
    rows = np.concatenate(out) if out else np.empty((0, 6), dtype=np.int64)
    return rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]


def _n_hits(items: Items, t: Template) -> int:
    total = 0
    for (k, mode), (h, _, _, seen) in items.windows.items():
        mine, some = t.windows(mode, k)
        at = mine[some & seen[mine >> np.uint64(48)]]
        total += int((np.searchsorted(h, at, "right") - np.searchsorted(h, at, "left")).sum())
    return total


def matches(items: Items, texts: list[bytes]) -> dict[int, list[tuple[int, str, float, int]]]:
    """Per text number: (item id, kind, covered part, longest run in words) of every item it holds."""
    t, it = Template(texts), items.template
    chunks = _n_hits(items, t) // HITS + 1
    covered: dict[tuple[int, int], list] = {}
    for chunk in range(chunks):
        rows = _hits(items, t, chunk, chunks)
        new = np.flatnonzero(np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1), [True]))) if len(rows) else np.empty(0, dtype=np.int64)
        for a, b in zip(new[:-1], new[1:], strict=True):
            d, i, shift = (int(x) for x in rows[a, :3])
            base = int(it.first[i])
            mask = np.zeros((3, int(it.first[i + 1]) - base), dtype=bool)
            for s, k, mode in rows[a:b, 3:].tolist():
                mask[mode, s - base : s - base + k] = True
            typed = mask[TYPED] | mask[STARTS]
            where = np.flatnonzero(typed) + base
            kind = np.where(it.begins[where] & mask[STARTS][where - base], NAME, it.kind[where])
            slots = where[kind != LITERAL]
            theirs = t.value[slots + shift]
            same = bool((it.value[slots] == theirs).all())
            if not _agrees(kind[kind != LITERAL], it.value[slots], it.size[slots], theirs):
                typed[:] = False
                for s, k, mode in rows[a:b, 3:].tolist():
                    if mode == TYPED and (it.kind[s : s + k] == LITERAL).all():
                        typed[s - base : s - base + k] = True
                same = True
            typed |= mask[PLAIN]  # the same words: nothing to check
            if typed.any():
                sum_ = covered.setdefault((d, i), [np.zeros(len(typed), dtype=bool), True])
                sum_[0] |= typed
                sum_[1] &= same
    out: dict[int, list] = {}
    for (d, i), (mask, same) in sorted(covered.items()):
        edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
        run, part = int((edges[1::2] - edges[::2]).max()), float(mask.mean())
        if part >= COVERED or run >= RUN:
            out.setdefault(d, []).append((items.ids[i], "exact" if same else "reparameterised", part, run))
    return out


MATCH = "array<struct<item_id: bigint, kind: string, covered: double, run: bigint>>"


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The benchmark in blocks of bounded size, streamed through the driver one row at a time."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(id_col, text_col).filter(F.col(id_col).isNotNull()).orderBy(id_col, text_col).toLocalIterator():
        text = r[1] or ""
        if texts and size + len(text) > BLOCK_BYTES:
            yield Items.of(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r[0])
        texts.append(text)
        size += len(text)
    if texts:
        yield Items.of(ids, texts)


def _finder(block):
    @F.pandas_udf(MATCH)
    def found(texts: pd.Series) -> pd.Series:
        out = []
        for _, held in batches(texts):
            hit = matches(block(), held)
            out += [[{"item_id": a, "kind": b, "covered": c, "run": d} for a, b, c, d in hit.get(i, ())] for i in range(len(held))]
        return pd.Series(out, dtype=object)

    return found


def _by_block(spark, benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[object, bool]]:
    """(function that finds the items of a block, whether it's the only one); a block's broadcast ends with its turn."""
    every = blocks(benchmark, id_col, text_col)
    first = next(every, None)
    if first is None:
        return
    second = next(every, None)
    for block in chain([first], () if second is None else chain([second], every)):
        get = share(spark, block)
        yield _finder(get), second is None
        if second is not None:
            get.sent.destroy()


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and benchmark item that it holds: id, item_id, kind, covered, run."""
    out = None
    for found, alone in _by_block(docs.sparkSession, benchmark, item_id, item_text):
        m = docs.select(F.col(id_col).alias("_id"), F.explode(found(F.col(text_col))).alias("_m"))
        part = m.select(F.col("_id").alias(id_col), "_m.*")
        part = part if alone else cut(part)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.filter("false").select(F.col(id_col), F.explode(F.array().cast(MATCH)).alias("_m")).select(id_col, "_m.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with their columns."""
    for found, alone in _by_block(docs.sparkSession, benchmark, item_id, item_text):
        clean = docs.filter(F.size(found(F.col(text_col))) == 0)
        docs = clean if alone else cut(clean)
    return docs
