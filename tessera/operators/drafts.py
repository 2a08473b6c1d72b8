"""Texts with structure: templates, anchored patches, sections, claims, enumerations, leaks, chats."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import answer_cue
from tessera.operators.spans import occurrences, piece, word_tokens

# ---- templates -------------------------------------------------------------------------------------------------------

FIELD = re.compile(r"\{([A-Za-z_][A-Za-z0-9_]*)(?::(int|signed|text))?\}")


def compiled(template: str) -> tuple[str, list[tuple[str, str]]]:
    """(anchored pattern, fields) of a template such as ``add(n={n:int}, tag="{tag:text}")``; a field is an int, a signed int or text without quotes."""
    parts, fields, at = [], [], 0
    for m in FIELD.finditer(template):
        kind = m.group(2) or "text"
        parts += ["\\Q" + template[at : m.start()] + "\\E" if m.start() > at else "", {"int": "(-?[0-9]+)", "signed": "([+-][0-9]+|0)", "text": '([^"\\n]*)'}[kind]]
        fields.append((m.group(1), kind))
        at = m.end()
    if len({n for n, _ in fields}) != len(fields):
        raise ValueError(f"a field is named twice: {template!r}")
    return "^" + "".join(parts) + ("\\Q" + template[at:] + "\\E" if at < len(template) else "") + "$", fields


def rendered(template: str, values: dict[str, Column]) -> Column:
    """The template with the values put in; signed integers get their sign."""
    parts, at = [], 0
    for m in FIELD.finditer(template):
        v = values[m.group(1)].cast("string")
        signed = F.when(values[m.group(1)].cast("long") > 0, F.concat(F.lit("+"), values[m.group(1)].cast("long").cast("string"))).otherwise(v)
        parts += [F.lit(template[at : m.start()]), signed if m.group(2) == "signed" else v]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def parsed(text: Column, template: str) -> Column:
    """A struct of the template's fields; null where the text isn't the template, or doesn't come out of it again."""
    pattern, fields = compiled(template)
    cast = {"int": "long", "signed": "long", "text": "string"}
    got = {n: F.regexp_extract(text, pattern, i + 1).cast(cast[k]) for i, (n, k) in enumerate(fields)}
    again = rendered(template, got) == text
    return F.when(text.rlike(pattern) & again, F.struct(*[c.alias(n) for n, c in got.items()]))


# ---- patches, sections, intervals ------------------------------------------------------------------------------------


def anchored(text: Column, edits: Column) -> Column:
    """Edits (old, new) as patches (start, end, text, issue): the old text must occur exactly once."""

    def place(e: Column) -> Column:
        n = occurrences(text, e["old"])
        at = (F.instr(text, e["old"]) - 1).cast("long")
        # A text that overlaps itself counts as found twice.
        again = F.instr(F.substring(text, (at + 2).cast("int"), F.length(text)), e["old"]) > 0
        issue = F.when(n == 0, "absent").when((n > 1) | again, "ambiguous").when(e["old"] == e["new"], "no_op")
        return F.struct(F.when(issue.isNull(), at).alias("start"), F.when(issue.isNull(), at + F.length(e["old"])).alias("end"), e["new"].alias("text"), issue.alias("issue"))

    return F.transform(edits, place)


def permuted_sections(text: Column, order: Column, title: str = "Step") -> Column:
    """Sections ``<title> i: ...`` between blank lines in another order (1-based), numbered anew."""
    parts = F.split(text, "\n\n")
    body = lambda i: F.regexp_replace(F.element_at(parts, i.cast("int")), f"^{title} [0-9]+: ", "")
    return F.array_join(F.transform(order, lambda i, k: F.concat(F.lit(f"{title} "), (k + 1).cast("string"), F.lit(": "), body(i))), "\n\n")


def inverse_order(order: Column) -> Column:
    """The order that undoes ``order``."""
    return F.transform(F.sequence(F.lit(1), F.size(order)), lambda i: F.array_position(order, i))


def mapped_back(start: Column, end: Column, patches: Column) -> Column:
    """The range of the unpatched text that [start, end) of the patched text came from; null where it meets a patch.

    patches: sorted (start, end, text) of the unpatched text.
    """
    grown = lambda p: F.length(p["text"]) - (p["end"] - p["start"])
    state = F.struct(F.lit(0).cast("long").alias("shift"), F.lit(0).cast("long").alias("before"), F.lit(True).alias("ok"))

    def step(s: Column, p: Column) -> Column:
        a = p["start"] + s["shift"]
        b = a + F.length(p["text"])
        return F.struct((s["shift"] + grown(p)).alias("shift"), F.when(b <= start, s["before"] + grown(p)).otherwise(s["before"]).cast("long").alias("before"), (s["ok"] & ((b <= start) | (a >= end))).alias("ok"))

    return F.aggregate(patches, state, step, lambda s: F.when(s["ok"], F.struct((start - s["before"]).cast("long").alias("start"), (end - s["before"]).cast("long").alias("end"))))


def match_spans(text: Column, pattern: str) -> Column:
    """Spans (start, end, text) in code points of every match of a pattern without groups that never matches nothing."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    empty = F.expr("named_struct('at', 0L, 'out', cast(array() AS array<struct<start: bigint, end: bigint, text: string>>))")

    def step(s: Column, x: Column) -> Column:
        a = s["at"] + F.length(x["gap"])
        b = (a + F.length(x["hit"])).cast("long")
        return F.struct(b.alias("at"), F.concat(s["out"], F.array(F.struct(a.cast("long").alias("start"), b.alias("end"), x["hit"].alias("text")))).alias("out"))

    return F.aggregate(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))), empty, step, lambda s: s["out"])


# ---- claims and leaks ------------------------------------------------------------------------------------------------


def claim_results(text: Column, patterns: dict[str, str], facts: dict[str, Column]) -> Column:
    """(name, claimed, expected, status) of each number that a pattern finds; a fact that is null makes it unknown, no claim of a name missing."""

    def one(name: str) -> Column:
        expected = facts[name].cast("long") if name in facts else F.lit(None).cast("long")
        found = F.transform(F.regexp_extract_all(text, F.lit(patterns[name]), F.lit(1)), lambda x: x.cast("long"))
        row = lambda claimed, status: F.struct(F.lit(name).alias("name"), claimed.alias("claimed"), expected.alias("expected"), status.alias("status"))
        judged = F.transform(found, lambda c: row(c, F.when(expected.isNull(), "unknown").when(c == expected, "pass").otherwise("fail")))
        return F.when(F.size(found) > 0, judged).otherwise(F.array(row(F.lit(None).cast("long"), F.lit("missing"))))

    return F.concat(*[one(n) for n in patterns])


def bare_tokens(text: Column, wrappers: int = 3) -> Column:
    """Tokens between white space without outer punctuation, and without up to three pairs of brackets, quotes or ticks."""
    out = F.split(F.btrim(F.regexp_replace(text, "\\s+", " ")), " ")
    for _ in range(wrappers):
        out = F.transform(out, lambda t: F.regexp_replace(F.regexp_replace(t, "[.,;:!?]+$", ""), "^(?:\\((.*)\\)|`(.*)`|\"(.*)\"|'(.*)'|<(.*)>)$", "$1$2$3$4$5"))
    return F.filter(F.transform(out, lambda t: F.regexp_replace(t, "[.,;:!?]+$", "")), lambda t: t != "")


#: A clause that names the product of a step.
PRODUCT_CLAUSE = "(?i)\\b(?:final |resulting )?product(?: smiles)?(?: is|:| =)\\s*(\\S+)"


def answer_leaks(text: Column, answers: Column) -> Column:
    """Why a text gives an answer away: its wording, a product clause, or a token that is an answer."""
    return F.array_compact(F.array(
        F.when(answer_cue(text), F.lit("cue")), F.when(text.rlike(PRODUCT_CLAUSE), F.lit("product_clause")), F.when(F.arrays_overlap(bare_tokens(text), answers), F.lit("answer_token")),
    ))


def without_leaks(text: Column, answers: Column) -> Column:
    """The text without the lines that give an answer away."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: F.size(answer_leaks(line, answers)) == 0), "\n")


# ---- enumerations ----------------------------------------------------------------------------------------------------

#: Number words.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
_NUMBER = "(?:[0-9]{1,4}|" + "|".join(NUMBER_WORDS) + ")"
_TOTALS = (
    re.compile(rf"[,:]? (?:totaling|for a total of|=) (?P<total>{_NUMBER}) (?P<unit>\w+(?: \w+)?)", re.I),
    re.compile(rf"\b(?P<total>{_NUMBER}) (?P<unit>\w+(?: \w+)?) \((?P<items>[^()]*(?:\([^()]*\)[^()]*)*)\)", re.I),
    re.compile(rf"\b(?P<unit>\w+(?: \w+)?): (?P<total>{_NUMBER}) \((?P<items>[^()]*(?:\([^()]*\)[^()]*)*)\)", re.I),
)
_MARK = re.compile("=|total", re.I)
_LEADING = re.compile(rf"^(?:contains |has |it |the |and |count |with |are |there )*(?P<n>{_NUMBER})\b", re.I)
_ANYWHERE = re.compile(rf"\b{_NUMBER}\b", re.I)


def number_of(word: str) -> int:
    return int(word) if word.isdigit() else NUMBER_WORDS.index(word.lower())


_PIECE = re.compile(r"\d+(?:,\d+)+|\(|\)|,(?!\d)|\+|\s+(?:and|plus)\s+|[^(),+\s]+|\s+|,", re.I)


def items_of(text: str) -> list[str]:
    """Parts between commas, plus signs and conjunctions outside brackets."""
    depth, parts, held = 0, [], []
    for token in _PIECE.findall(text):
        depth += (token == "(") - (token == ")" and depth > 0)
        if depth == 0 and (token in (",", "+") or (token[0].isspace() and token.strip().lower() in ("and", "plus"))):
            parts.append("".join(held))
            held = []
        else:
            held.append(token)
    return [p for x in [*parts, "".join(held)] if (p := re.sub(r"^(?:and|plus) ", "", x.strip(" ,+"), flags=re.I))]


def count_of(item: str, implicit: bool) -> int | None:
    """How many an item stands for: its leading number, the sum in its brackets, or one; None where that isn't clear."""
    numbers = _ANYWHERE.findall(re.sub(r"\(.*\)", "", item))
    if len(numbers) > 1:
        return None
    if m := _LEADING.search(item):
        return number_of(m.group("n"))
    if m := re.search(r"\((.*)\)$", item):
        return number_of(m.group(1)) if re.fullmatch(_NUMBER, m.group(1), re.I) else total_of(m.group(1), True)
    words = item.split()
    return 1 if implicit and words and len(words) <= 6 and not numbers and not words[-1].lower().endswith("s") else None


def _summed(parts: list[str], implicit: bool) -> int | None:
    total = 0
    for part in parts:
        if (n := count_of(part, implicit)) is None:
            return None
        total += n
    return total if parts else None


def total_of(text: str, implicit: bool) -> int | None:
    return _summed(items_of(text), implicit)


def false_totals(text: str | None) -> list[str]:
    """Statements whose parts don't add up to the total they give; what can't be counted for sure is passed over.

    A total at the end of its clause is looked for first, then its clause is read, so time is in proportion to the text.
    """
    out, free = [], 0
    text = text or ""
    held = (_MARK.search(text) is not None, "(" in text, "(" in text and ":" in text)
    for k, pattern in enumerate(_TOTALS):
        for m in pattern.finditer(text) if held[k] else ():
            start = m.start()
            if k == 0:
                start = max(free, *(text.rfind(c, free, m.start()) + 1 for c in ".;:\n"))
                free = m.end()
            items = text[start : m.start()] if k == 0 else m.group("items")
            parts = items_of(items)
            if len(parts) > 1 and (total := _summed(parts, k > 0)) is not None and total != number_of(m.group("total")):
                out.append(text[start : m.end()].strip())
    return out


def enumeration_violations(text: Column) -> Column:
    """Arrow-batched: an array of the statements in each text whose enumeration has a false total."""

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(false_totals, na_action=None)

    return found(text)


# ---- nested values and chats -----------------------------------------------------------------------------------------


def lines_of(value) -> str:
    if isinstance(value, dict):
        return "\n".join(f"{k}: {lines_of(v)}" for k, v in value.items())
    return "\n".join(map(lines_of, value)) if isinstance(value, list) else str(value)


def flattened(text: Column) -> Column:
    """JSON as ``key: value`` lines, nested values below each other; null where the text isn't JSON."""

    @F.pandas_udf("string")
    def flat(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else lines_of(json.loads(t))
            except (ValueError, RecursionError):
                return None

        return texts.map(one, na_action=None)

    return flat(text)


def listed(meta: Column, keys: list[str]) -> Column:
    """Strings under the keys of a JSON object, each a string or a list, in the order of keys; malformed JSON has none."""
    v = F.try_parse_json(meta)
    none = F.array().cast("array<string>")

    def under(key: str) -> Column:
        value = F.try_variant_get(v, f"$.{key}", "variant")
        kind = F.schema_of_variant(value)
        return F.when(kind == "STRING", F.array(F.try_variant_get(v, f"$.{key}", "string"))).when(kind.startswith("ARRAY"), F.coalesce(F.try_variant_get(v, f"$.{key}", "array<string>"), none)).otherwise(none)

    return F.concat(*[under(k) for k in keys])


#: The declared chat template and its control tags.
OPEN, CLOSE, CONTROL = "<|im_start|>", "<|im_end|>\n", "<\\|[a-z_]+\\|>"


def rendered_chat(messages: Column) -> Column:
    """(text, spans) of messages (role, content): the declared template, and where the assistant's contents stand in it."""
    empty = F.expr("named_struct('text', '', 'spans', cast(array() AS array<struct<start: bigint, end: bigint>>))")

    def step(s: Column, m: Column) -> Column:
        head = F.concat(s["text"], F.lit(OPEN), m["role"], F.lit("\n"))
        a = F.length(head).cast("long")
        span = F.array(F.struct(a.alias("start"), (a + F.length(m["content"])).alias("end")))
        return F.struct(F.concat(head, m["content"], F.lit(CLOSE)).alias("text"), F.when(m["role"] == "assistant", F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(messages, empty, step)


def eligible_tokens(text: Column, spans: Column) -> Column:
    """(n_tokens, positions): all tokens of a rendered chat, and the places of those inside a span that touch no control tag."""
    tokens, tags = word_tokens(text), match_spans(text, CONTROL)
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  evaluated once
    inside = lambda t: F.exists(spans, lambda s: (t["start"] >= s["start"]) & (t["end"] <= s["end"]))

    def places(ts: Column, marks: Column) -> Column:
        free = lambda t: ~F.exists(marks, lambda m: (m["start"] < t["end"]) & (t["start"] < m["end"]))
        at = F.transform(ts, lambda t, i: F.when(inside(t) & free(t), i.cast("long")))
        return F.struct(F.size(ts).cast("long").alias("n_tokens"), F.array_compact(at).alias("positions"))

    return bound(tokens, lambda ts: bound(tags, lambda ms: places(ts, ms)))


# ---- context ---------------------------------------------------------------------------------------------------------


def range_lookup(points: DataFrame, ranges: DataFrame, key: str, point: str, start: str, end: str, width: int) -> DataFrame:
    """Points joined with the range [start, end) of their key that holds them; ranges are cut into buckets of ``width``, so it's an equi-join."""
    p = points.withColumn("_b", F.floor(F.col(point) / width))
    r = ranges.filter(F.col(start) < F.col(end)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    return p.join(r, [key, "_b"]).filter((F.col(start) <= F.col(point)) & (F.col(point) < F.col(end))).drop("_b")


def context(text: Column, at: Column, around: int) -> Column:
    """(start, end, text): what stands within ``around`` characters of a place, clipped to the text."""
    a, b = F.greatest(at - around, F.lit(0)), F.least(at + around, F.length(text))
    return F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), piece(text, a, b).alias("text"))
