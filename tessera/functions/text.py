"""Text scalars: whitespace normal form, digests, redaction, answer extraction, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space in texts (Unicode, as Python's str.split has them).
WHITESPACE = "\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


def norm(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.btrim(F.regexp_replace(text, f"[{WHITESPACE}]+", " "))


def digest(value: Column) -> Column:
    """SHA-256 of a string's UTF-8 bytes, lower-case hex."""
    return F.sha2(value, 256)


def canonical_json(*fields: tuple[str, Column]) -> Column:
    """Compact JSON of fields in alphabetical order, nulls kept."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields, key=lambda x: x[0])]), {"ignoreNullFields": "false"})


def first_non_blank(*options: tuple[str, Column]) -> tuple[Column, Column]:
    """(name, text) of the first option with other than white space, code fences taken off."""
    name, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for label, c in reversed(options):
        some = F.coalesce(norm(c), F.lit("")) != ""
        name, text = F.when(some, F.lit(label)).otherwise(name), F.when(some, c).otherwise(text)
    bare = F.regexp_replace(F.btrim(text), "^```[A-Za-z]*\\s*\\n?|\\n?```$", "")
    return name, F.btrim(bare)


def extract_answer(response: Column) -> Column:
    """(answer, method): the last answer tag; nothing while a think tag is open; else the last ``Answer:`` line."""
    tags = F.regexp_extract_all(response, F.lit("(?s)<answer>(.*?)</answer>"), F.lit(1))
    after = F.substring_index(response, "</think>", -1)
    lines = F.regexp_extract_all(after, F.lit("(?im)^[ \\t]*answer[ \\t]*:[ \\t]*(.*)$"), F.lit(1))
    open_ = response.contains("<think>") & ~response.contains("</think>")
    picked = F.when(F.size(tags) > 0, F.element_at(tags, -1)).when(open_, F.lit("")).when(F.size(lines) > 0, F.element_at(lines, -1)).otherwise(F.lit(""))
    bare = F.btrim(picked, F.lit(" \t\r\n`'\""))
    valid = ~bare.rlike("[\\s<>]")
    method = F.when(F.size(tags) > 0, F.lit("answer_tag")).when(open_, F.lit("unclosed_think")).when(F.size(lines) > 0, F.lit("answer_line")).otherwise(F.lit("missing"))
    return F.struct(F.when(valid, bare).otherwise(F.lit("")).alias("answer"), method.alias("method"))


def redact(text: Column, most: int = 400) -> Column:
    """Masks bearer tokens, key=value secrets and sk- keys; cuts long texts with a mark."""
    t = F.regexp_replace(text, "(?i)(authorization\\s*:\\s*|bearer\\s+)[A-Za-z0-9._~+/=-]+", "$1[REDACTED]")
    t = F.regexp_replace(t, "(?i)((?:api[_-]?key|token|secret|password)\\s*[=:]\\s*\"?)[A-Za-z0-9._-]+", "$1[REDACTED]")
    t = F.regexp_replace(t, "sk-[A-Za-z0-9_-]{8,}", "[REDACTED]")
    return F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit("...[cut]"))).otherwise(t)


def signed(value: Column) -> Column:
    """Integers with a plus sign where positive."""
    return F.concat(F.when(value > 0, F.lit("+")).otherwise(F.lit("")), value.cast("string"))


def without_version(name: Column) -> Column:
    """A name without its trailing _v and number."""
    return F.regexp_replace(name, "_v[0-9]+$", "")


def first_code(message: Column, needles: list[tuple[str, str]], otherwise: str = "other") -> Column:
    """The code of the first needle that the message contains."""
    out = F.lit(otherwise)
    for needle, code in reversed(needles):
        out = F.when(message.contains(needle), F.lit(code)).otherwise(out)
    return out


def false_equations(text: Column) -> Column:
    """Sums and differences of numbers in a text, such as ``14 - 9 = 6``, whose stated result is wrong."""
    num = "[0-9]{1,15}(?:\\.[0-9]{1,9})?"
    found = F.regexp_extract_all(text, F.lit(f"(?<![0-9.])({num}(?: ?[+-] ?{num})+ ?= ?-?{num})(?![0-9.]*[0-9])"), F.lit(1))

    def wrong(eq: Column) -> Column:
        left, right = F.split(eq, " ?= ?").getItem(0), F.split(eq, " ?= ?").getItem(1)
        terms = F.regexp_extract_all(F.concat(F.lit("+"), F.replace(left, F.lit(" "), F.lit(""))), F.lit(f"([+-]{num})"), F.lit(1))
        total = F.aggregate(terms, F.lit(0).cast("decimal(38,10)"), lambda s, t: (s + t.cast("decimal(25,10)")).cast("decimal(38,10)"))
        return total != right.cast("decimal(38,10)")

    return F.filter(found, wrong)


def answer_cue(text: Column) -> Column:
    """Whether a text gives an answer away by its wording."""
    return text.rlike("(?i)\\b(?:the\\s+)?(?:final\\s+|correct\\s+)?answer\\s*(?:is|:|=)|<answer>|\\bground[ _-]?truth\\b")
