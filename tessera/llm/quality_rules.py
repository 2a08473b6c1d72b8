"""Quality rules: a threshold table compiled into one projection, without user functions.

Measures of a text (null: no words): counts of words, characters, symbols, capitals, stop words,
repeated lines and words in repeated three-word windows. Rules compare two of them in integers,
so that every engine gets the same verdict.

Defined results: null and empty texts have all measures 0 and fail ``too_short``; texts of any
length are read whole; other columns may have any name, as the measures are one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the and of to a in that is was for with on at by it as be this from or "
    "le la les de des et un une est que qui dans pour sur par "
    "der die das und ist mit den dem von zu ein eine auf im nicht sich "
    "el los las y en por con lo se su es no al del"
).split()
_WS = " \\t\\n\\u000B\\u000C\\r"
_CLASS = "[\\\\x20\\\\x09-\\\\x0D]+"
_PUNCT = ".,;:!?"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: name, left measure, factor, right measure or None, factor: the rule fails where left * factor > right * factor.
#: A None stands for 1. The first two are the base rules.
RULES: tuple[tuple[str, str | None, int, str | None, int], ...] = (
    ("too_short", None, 50, "n_words", 1),
    ("repeated_words", "n_repeat_words", 100, "n_words", 50),
    ("symbols", "n_symbols", 10, "n_words", 1),
    ("repeated_lines", "n_dup_lines", 2, "n_lines", 1),
    ("capitals", "n_upper", 10, "word_chars", 4),
    ("long_words", "word_chars", 1, "n_words", 14),
    ("short_words", "n_words", 2, "word_chars", 1),
    ("few_stop_words", "n_words", 1, "n_stop_words", 50),
)
BASE = 2
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_upper")


def _let(name: str, value: str, body: str) -> str:
    """Evaluates ``value`` once for all uses of ``name`` in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeat_words() -> str:
    """Words in windows of three that occur twice or more, of the word array ``w``.

    Window hashes of 64 bits are sorted with their position in the low bits; equal neighbours are
    confirmed by the whole hash. Sorting keeps it at n log n for texts of any length.
    """
    hashes = "transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))"
    keys = "sort_array(transform(h, (x, i) -> shiftleft(shiftrightunsigned(x, b), b) | i))"
    same = "h[int(v & m)] = h[int(k[j {0} 1] & m)]"
    dups = f"filter(k, (v, j) -> (j > 0 AND k[greatest(j - 1, 0)] >= (v & ~m) AND {same.format('-')}) OR (j < size(k) - 1 AND k[least(j + 1, size(k) - 1)] <= (v | m) AND {same.format('+')}))"
    covered = "aggregate(sort_array(transform(d, v -> v & m)), named_struct('n', 0L, 'e', 0L), (s, p) -> named_struct('n', s.n + p + 3L - greatest(s.e, p), 'e', p + 3L), s -> s.n)"
    # Most texts repeat no window: then nothing is sorted.
    body = _let("h", hashes, "if(size(array_distinct(h)) = size(h), 0L, {})".format(_let("b", "length(bin(size(w)))", _let("m", "shiftleft(1L, b) - 1L", _let("k", keys, _let("d", dups, f"if(size(d) = 0, 0L, {covered})"))))))
    return f"if(size(w) < 3, 0L, {body})"


def _failed(m: str, rules) -> str:
    """SQL for the names of the rules that the measures in struct ``m`` fail, in the table's order."""
    side = lambda name, factor: f"{factor}L" if name is None else f"{m}.{name} * {factor}L"
    return "array_compact(array(" + ", ".join(f"if({side(left, f)} > {side(right, g)}, '{name}', NULL)" for name, left, f, right, g in rules) + "))"


def verdict(text_col: str = "text", rules=RULES) -> Column:
    """A struct of all measures of one text, ``failed`` (names of rules) and ``kept``.

    It's one expression whose parts are bound once, so a filter on it that Spark pushes down doesn't repeat them.
    """
    stop = ", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))
    fields = {
        "n_words": "bigint(size(w))",
        "word_chars": "bigint(length(array_join(w, '')))",
        "n_symbols": "if(t RLIKE '[#*$%&|<>]', bigint(length(t) - length(translate(t, '#*$%&|<>', ''))), 0L)",
        "n_lines": "bigint(size(l))",
        "n_dup_lines": "bigint(size(l) - size(array_distinct(l)))",
        "n_repeat_words": _repeat_words(),
        "n_stop_words": f"bigint(size(filter(w, x -> lower(trim(BOTH '{_PUNCT}' FROM x)) IN ({stop}))))",
        "n_upper": f"bigint(length(t) - length(translate(t, '{_UPPER}', '')))",
    }
    struct = "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
    words = f"if(c = '', array(), split(c, '{_CLASS}'))"
    lines = f"filter(split(t, '\\n'), x -> trim(BOTH '{_WS}' FROM x) <> '')"
    judged_ = "named_struct(" + ", ".join(f"'{k}', q.{k}" for k in MEASURES) + ", 'failed', r, 'kept', size(r) = 0)"
    body = _let("c", f"trim(BOTH '{_WS}' FROM t)", _let("w", words, _let("l", lines, _let("q", struct, _let("r", _failed("q", rules), judged_)))))
    return F.expr(_let("t", f"coalesce(`{text_col}`, '')", body))


def judged(docs: DataFrame, text_col: str = "text", rules=RULES, out: str = "_quality") -> DataFrame:
    """Adds a struct ``out``: the measures, ``failed`` and ``kept``."""
    return docs.withColumn(out, verdict(text_col, rules))


def keep_good(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows that pass every rule, with the columns they came with."""
    return docs.filter(verdict(text_col, rules)["kept"])


def _duck_words() -> str:
    return "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def oracle(rules=RULES) -> str:
    """The same measures and verdicts in DuckDB."""
    side = lambda name, factor: f"{'1' if name is None else name} * {factor}"
    test = lambda chosen: " OR ".join(f"({side(a, f)} > {side(b, g)})" for _, a, f, b, g in chosen)
    stop = ", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))
    ws = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t, {_duck_words()} AS w FROM documents),
win AS (SELECT doc_id, i, md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) >= 3)),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
       FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM base) WHERE trim(l, {ws}) <> '' GROUP BY doc_id),
m AS (SELECT b.doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(translate(t, {ws}, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        CAST(coalesce(ln.n_lines, 0) AS BIGINT) AS n_lines,
        CAST(coalesce(ln.n_dup, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(list_filter(w, lambda x: lower(trim(x, '{_PUNCT}')) IN ({stop}))) AS BIGINT) AS n_stop_words,
        CAST(length(t) - length(translate(t, '{_UPPER}', '')) AS BIGINT) AS n_upper
      FROM base b LEFT JOIN rep ON rep.doc_id = b.doc_id LEFT JOIN ln ON ln.doc_id = b.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({test(rules[:BASE])}) AS base_failed, NOT ({test(rules)}) AS kept
FROM m"""
