"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment confirms.

A template of t shingles (five words, lower-cased, without outer punctuation) is looked for in windows
of two neighbouring blocks of s shingles, s the power of two with t <= s < 2 t, so every run of t
shingles lies inside one window. Every window of a text is hashed: minima of blocks are merged to those
of larger blocks and of windows. Each of BANDS bands of one MinHash is looked up in the band's index of
templates. A window that contains CONTAINED of a template has a similarity of at least 0.75 / 4.25 to
it, so some band finds it with a chance above 1 - 5e-6. Retrieved windows are verified by exact
containment, and of places that overlap the one that holds the most shingles of its template stands, so
one place has one license.

Defined results: null and empty texts match nothing; templates under five words are refused; texts are
read whole; a notice that occurs several times is reported for each separate place; repeated rows have
repeated results; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.license_texts import TEMPLATES
from tessera.llm.words import Words, batches, mix64, rolled, share

SHINGLE, BANDS, CONTAINED = 5, 64, 0.75
_MUL = mix64(np.arange(1, BANDS + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mix64(np.arange(5001, BANDS + 5001, dtype=np.uint64))
#: Bytes of text whose windows are hashed at once.
BATCH = 1 << 18
#: Bits of a minimum that the bands' tables of known values look at.
TABLE = 12


@dataclass
class Scanner:
    """Names and shingle sets of all templates, and for each size of block the bands' index."""

    names: list[str]
    sets: list[np.ndarray]
    index: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def of(templates=TEMPLATES) -> Scanner:
        sets = []
        for _, text in templates:
            h = Words([text.encode()], strip=True).hash
            if len(h) < SHINGLE:
                raise ValueError(f"a template needs {SHINGLE} words: {text!r}")
            sets.append(np.unique(rolled(h, SHINGLE)))
        of_size: dict[int, list[int]] = {}
        for i, s in enumerate(sets):
            of_size.setdefault(1 << int(len(s) - 1).bit_length(), []).append(i)
        index = {}
        for block, members in sorted(of_size.items()):
            values = np.stack([(_MUL[:, None] * sets[i][None, :] + _ADD[:, None]).min(axis=1) for i in members], axis=1)
            order = np.argsort(values, axis=1)
            values = np.take_along_axis(values, order, axis=1)
            known = np.zeros((BANDS, 1 << TABLE), dtype=bool)
            for b in range(BANDS):
                known[b, values[b] >> np.uint64(64 - TABLE)] = True
            index[block] = (values, np.array(members)[order], known)
        return Scanner([n for n, _ in templates], sets, index)

    def _retrieved(self, shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct rows (block size, text, window, template): windows that agree with a template in some band.

        Texts are laid out in whole blocks of the largest size, filled up with the largest hash, so that blocks pair up.
        """
        largest, held = max(self.index), np.diff(first)
        room = -(-held // largest) * largest
        begin = np.cumsum(room) - room
        laid = np.full(int(room.sum()), np.iinfo(np.uint64).max, dtype=np.uint64)
        where = np.repeat(begin, held) + _within(held)
        ends = begin + room
        out = []
        for b in range(BANDS):
            laid[where] = shingles * _MUL[b] + _ADD[b]
            mins, size = laid, 1
            for block, (values, owner, known) in self.index.items():
                while size < block:
                    mins = np.minimum(mins[::2], mins[1::2])
                    size *= 2
                window = mins.copy()
                np.minimum(mins[:-1], mins[1:], out=window[:-1])
                last = ends[room > 0] // block - 1
                window[last] = mins[last]
                w = np.flatnonzero(known[b][window >> np.uint64(64 - TABLE)])
                if not len(w):
                    continue
                lo, hi = np.searchsorted(values[b], window[w], "left"), np.searchsorted(values[b], window[w], "right")
                n = hi - lo
                w = np.repeat(w, n)
                text = np.searchsorted(begin, w * block, side="right") - 1
                out.append(np.stack([np.full(len(w), block), text, w - begin[text] // block, owner[b][np.repeat(lo, n) + _within(n)]], axis=1))
        return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 4), dtype=np.int64)

    def scan(self, texts: list[bytes]) -> dict[int, list[tuple[str, float, int, int]]]:
        """Per text number: (license, contained part, first word, end word), places in order."""
        w = Words(texts, strip=True)
        every = rolled(w.hash, SHINGLE)
        text = np.searchsorted(w.first, np.arange(len(every)), side="right") - 1
        shingles = every[np.arange(len(every)) + SHINGLE <= w.first[text + 1]]
        first = np.concatenate(([0], np.cumsum(np.maximum(np.diff(w.first) - SHINGLE + 1, 0))))
        if not len(shingles):
            return {}
        places: dict[int, set] = {}
        for block, d, k, i in self._retrieved(shingles, first).tolist():
            a, b = int(first[d]) + k * block, min(int(first[d]) + (k + 2) * block, int(first[d + 1]))
            for contained, lo, hi in self._places(i, shingles[a:b]):
                shift = a - int(first[d])
                places.setdefault(d, set()).add((-round(contained * len(self.sets[i])), -contained, lo + shift, hi + shift, i))
        out = {}
        for d, found in sorted(places.items()):
            chosen: list = []
            for _, part, lo, hi, i in sorted(found):
                if not any(lo < e and s < hi for _, _, s, e in chosen):
                    chosen.append((self.names[i], -part, lo, hi))
            out[d] = sorted(chosen, key=lambda x: x[2:])
        return out

    def _places(self, i: int, part: np.ndarray) -> list[tuple[float, int, int]]:
        """(contained part, first word, end word) of template i in a window: of each close group of its shingles, or of all."""
        t = len(self.sets[i])
        where = np.flatnonzero(_member(self.sets[i], part))
        if not len(where):
            return []
        groups = np.split(where, np.flatnonzero(np.diff(where) > max(t // 2, 1)) + 1)
        found = [(len(np.unique(part[g])) / t, int(g[0]), int(g[-1]) + SHINGLE) for g in groups]
        found = [x for x in found if x[0] >= CONTAINED] or [(len(np.unique(part[where])) / t, int(where[0]), int(where[-1]) + SHINGLE)]
        return [x for x in found if x[0] >= CONTAINED]


def _within(count: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of ``count`` in turn."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


FOUND = "array<struct<license: string, contained: double, first_word: bigint, end_word: bigint>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row for each place of a license notice: id, license, contained, first_word, end_word."""
    scanner = share(docs.sparkSession, Scanner.of(templates))  # a few kilobytes

    @F.pandas_udf(FOUND)
    def found(texts: pd.Series) -> pd.Series:
        out = []
        for _, held in batches(texts, BATCH):
            got = scanner().scan(held)
            out += [[dict(zip(("license", "contained", "first_word", "end_word"), x, strict=True)) for x in got.get(i, ())] for i in range(len(held))]
        return pd.Series(out, dtype=object)

    rows = docs.select(F.col(id_col), F.explode(found(F.col(text_col))).alias("_m"))
    return rows.select(id_col, "_m.*")
