"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust scores.

Base kinds are email, ip, card (Luhn) and phone; the method adds iban (mod 97), ssn and secret
tokens, which need a context word or a checksum. Spans are code points, end exclusive.

Every pattern takes time in proportion to the text: runs of digits that can't begin an address are stepped
over whole, and runs that are too long for a kind are cut short after what its rule needs.

Defined results: null and empty texts have no spans; texts are read whole whatever their length;
equal texts and repeated rows have equal spans; an empty table gives no rows; other columns of the input
are not touched, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++\.[0-9]++\.[0-9]++)?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]++")
_IBAN = re.compile(r"[A-Z][A-Z][0-9]{2}(?:[ ]?[A-Z0-9]){11,30}\b")
_SSN = re.compile(r"[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}\b")
_DIGIT = re.compile("[0-9]")
_LONG = re.compile(r"\S{20,}")
_SECRET = re.compile(r"\b(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})\b")
#: Words that raise a kind's score when they stand whole within NEAR characters before a span.
CONTEXT = {
    "email": ("mail", "email", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "telephone", "call", "tel", "mobile", "cell", "fax"),
    "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("token", "secret", "key", "apikey", "password", "passwd", "api", "credential", "credentials"),
}
NEAR = 40
_CONTEXT_WORD = re.compile("[a-z]+")
#: Score of a span by kind: without and with a context word; spans under THRESHOLD are not reported.
SCORES = {"email": (0.9, 1.0), "ip": (0.6, 0.95), "card": (0.8, 1.0), "phone": (0.7, 0.95), "iban": (0.85, 1.0), "ssn": (0.3, 0.9), "secret": (0.3, 0.9)}
THRESHOLD = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping matches, found from each @ outwards so that other text costs nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(free, at + 1))


def _free(text: str, start: int) -> bool:
    """No word goes on to the left of ``start``."""
    return not (start and (text[start - 1].isalnum() or text[start - 1] == "_"))


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    """Only long words are looked into, each where it stands."""
    for m in _LONG.finditer(text):
        word, at = m.group(), m.start()
        if _DIGIT.search(word):
            yield from ((at + x.start(), at + x.end()) for x in _SECRET.finditer(word) if x.start() or _free(text, at))


def _ips(text: str, at: int) -> Iterator[tuple[int, int]]:
    """Leftmost matches of four numbers. A run of digits that none follows as asked can't begin a match at a later digit."""
    for m in _IP.finditer(text, at):
        parts = m.group().split(".")
        if len(parts) == 4 and all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in parts):
            yield m.start(), m.end()


def _ibans(text: str, at: int) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text, at):
        if _free(text, m.start()) and 15 <= len(c := m.group().replace(" ", "")) <= 34 and mod97(c):
            yield m.start(), m.end()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    """The match ends at the last digit of its run of allowed signs, and holds one sign between at least."""
    for m in _PHONE.finditer(text):
        end = m.start() + len(m.group().rstrip(" ().-"))
        if end - m.start() >= 4 and 10 <= sum(map(m.group().count, "0123456789")) <= 15:
            yield m.start(), end


def _context(before: str) -> set[str]:
    return set(_CONTEXT_WORD.findall(before))


def spans(text: str | None) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of every span, by start, then kind as listed."""
    text, found = text or "", []
    found += [(s, e, "email") for s, e in _emails(text)]
    if first := _DIGIT.search(text):  # every other kind holds a digit
        at = first.start()
        found += [(s, e, "ip") for s, e in _ips(text, at)]
        for m in _CARD.finditer(text, at):
            if 14 <= m.end() - m.start() <= 37 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(s, e, "phone") for s, e in _phones(text)]
        found += [(s, e, "iban") for s, e in _ibans(text, max(0, at - 2))]
        found += [(m.start(), m.end(), "ssn") for m in _SSN.finditer(text, at) if _free(text, m.start()) and m.group()[:3] not in ("000", "666") and m.group()[0] != "9"]
        found += [(s, e, "secret") for s, e in sorted(set(_secrets(text)))]
    out = []
    for start, end, kind in sorted(found, key=lambda x: (x[0], KINDS.index(x[2]))):
        score = SCORES[kind][not _context(text[max(0, start - NEAR) : start].lower()).isdisjoint(CONTEXT[kind])]
        if kind in BASE or score >= THRESHOLD:
            out.append((start, end, kind, score))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("score", T.DoubleType())]))
FOUND = T.StructType([T.StructField("base_key", T.StringType()), T.StructField("key", T.StringType()), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("least_score", T.DoubleType())])


def _key(found: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k, _ in found)


def find_pii(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """Adds ``out``, an array of (start, end, kind, score), to every row."""

    @F.pandas_udf(SPANS)
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(spans, na_action=None)

    return docs.withColumn(out, found(F.col(text_col)))


def redact(docs: DataFrame, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """Replaces every span by its kind in square brackets; of overlapping spans the earlier one stands."""
    step = "named_struct('at', greatest(s.at, p.end), 'out', if(p.start < s.at, s.out, concat(s.out, substring(t, int(s.at + 1), int(p.start - s.at)), '[', upper(p.kind), ']')))"
    text = f"transform(array(`{text_col}`), t -> aggregate(`{spans_col}`, named_struct('at', 0L, 'out', ''), (s, p) -> {step}, s -> concat(s.out, substring(t, int(s.at + 1)))))[0]"
    return docs.withColumn(text_col, F.expr(text))


def pii_summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, counts of the base kinds, digest of the base spans, all spans as text, lowest score."""

    @F.pandas_udf(FOUND)
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            every = spans(t)
            base = [x for x in every if x[2] in BASE]
            rows.append((_key(base), _key(every), [sum(x[2] == k for x in base) for k in BASE], min((x[3] for x in every), default=None)))
        return pd.DataFrame(rows, columns=["base_key", "key", "counts", "least_score"])

    r = docs.select(F.col(id_col), found(F.col(text_col)).alias("_r"))
    counts = [F.col("_r")["counts"][i].alias(f"n_{k}") for i, k in enumerate(BASE)]
    return r.select(id_col, *counts, F.sha2(F.col("_r")["base_key"], 256).alias("base_sha256"), F.col("_r")["key"].alias("spans"), F.col("_r")["least_score"].alias("least_score"))
