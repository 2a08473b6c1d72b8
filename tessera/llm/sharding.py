"""Reproducible shuffle and shards: a Feistel permutation with cycle walking over row numbers.

Rows get gapless global row numbers, a keyed Feistel network over the domain ``a * b >= N``
permutes them (walking on while a value lies outside ``[0, N)``), and shard and slot follow from
the permuted number alone. Only DataFrame functions are used.

Defined results: null text counts as empty; rows that agree in every numbered column are
interchangeable and each gets a place of its own, as do repeated rows; null ids count as values; texts
are measured whole; an empty table gives no rows; other columns of the input are ignored unless named in
``keep``, and their names may be anything: a kept column that is called like one of the results comes
with ``_kept`` behind its name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.words import spread
from tessera.session import cut

#: Rounds of the network; four are pseudorandom already, two more cost little.
ROUNDS = 6
#: Most steps of a walk; a step stays outside with a chance below 2 / sqrt(N).
WALK = 64
#: Rows that one task numbers, and buckets whose sums one task adds up.
BUCKET_ROWS, GROUP = 50_000, 1000


def feistel_domain(n: int) -> tuple[int, int]:
    """Sides a >= b of the smallest near-square domain with a * b >= n."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def permuted(column: str, n: int, seed: int) -> Column:
    """The place of the row number in ``column`` in a keyed permutation of ``[0, n)``."""
    a, b = feistel_domain(n)
    side = f"if(j % 2 = 0, {a}L, {b}L)"
    once = (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', w % {a}L, 'r', w div {a}L), "
        f"(s, j) -> named_struct('l', s.r, 'r', pmod(s.l + pmod(xxhash64(s.r, j, {seed}L), {side}), {side})), "
        f"s -> {f's.r + s.l * {b}L' if ROUNDS % 2 else f's.l + s.r * {a}L'})"
    )
    walk = min(WALK, a * b - n + 1)
    # The first step is outside the loop: nearly every row ends with it.
    return F.expr(
        f"aggregate(sequence(1, {walk}), -1L, (v, k) -> if(v >= 0L AND v < {max(n, 1)}L, v, "
        f"transform(array(if(k = 1, {column}, v)), w -> {once})[0]), "
        f"v -> if(v < {max(n, 1)}L, v, raise_error('the walk did not end')))"
    )


def running_offsets(sums: DataFrame, part: str, value: str, by: tuple[str, ...] = (), out: str = "_offset") -> DataFrame:
    """(``by``, part, out): the sum of ``value`` over the parts before each, added up in groups of GROUP parts and over the groups."""
    grouped = sums.select(*by, part, value, F.expr(f"`{part}` div {GROUP}").alias("_group"))
    whole = grouped.groupBy(*by, "_group").agg(F.sum(value).alias("_in_group"))
    over = (Window.partitionBy(*by) if by else Window).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    ahead = whole.select(*by, "_group", F.coalesce(F.sum("_in_group").over(over), F.lit(0)).alias("_ahead"))
    inner = F.sum(value).over(Window.partitionBy(*by, "_group").orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    keys = [*by, "_group"]
    return grouped.withColumn("_before", F.coalesce(inner, F.lit(0))).join(ahead, keys).select(*by, part, (F.col("_before") + F.col("_ahead")).alias(out))


def numbered(distinct: DataFrame, order: list[str], n_buckets: int) -> DataFrame:
    """Adds ``_position``: gapless row numbers in an order that depends on the columns of ``order`` alone.

    Equal rows come once, with their number in ``_copies``, and are spread again at the end, so that no task holds a hot row's copies.
    """
    hashed = distinct.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n_buckets)).cast("int"))
    offsets = running_offsets(hashed.groupBy("_bucket").agg(F.sum("_copies").alias("_in_bucket")), "_bucket", "_in_bucket")
    before = F.sum("_copies").over(Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    placed = hashed.withColumn("_first", F.coalesce(before, F.lit(0))).join(offsets, "_bucket")
    return spread(placed, "_copies", "_copy").select(*order, (F.col("_first") + F.col("_offset") + F.col("_copy")).alias("_position"))


def assign_shards(docs: DataFrame, n_shards: int = 16, seed: int = 20_240_611, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Puts every row into one of ``n_shards`` shards whose row counts differ by one at most.

    Returns ``id_col``, size (UTF-8 bytes and 1), text_crc32, ``keep``, position (the row's place in the
    shuffle), shard (position mod n_shards) and slot (position div n_shards). Any slot's content can be
    computed without reading the others.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    order = ["_c0", "_c1", "_c2", *(f"_c{i + 3}" for i in range(len(keep)))]
    values = [F.col(f"`{id_col}`"), (F.octet_length(text) + 1).cast("long"), F.crc32(text.cast("binary")).cast("long"), *(F.col(f"`{k}`") for k in keep)]
    light = docs.select(*[v.alias(n) for v, n in zip(values, order, strict=True)])
    # Short columns, so that texts are read once.
    light = cut(light.groupBy(*order).agg(F.count(F.lit(1)).alias("_copies")))
    n = light.agg(F.coalesce(F.sum("_copies"), F.lit(0)).alias("n")).first()["n"]
    rows = numbered(light, order, max(1, -(-n // BUCKET_ROWS))).withColumn("_place", permuted("_position", n, seed))
    taken = {id_col, "size", "text_crc32", "position", "shard", "slot"}
    names = [id_col, "size", "text_crc32", *(f"{k}_kept" if k in taken else k for k in keep)]
    return rows.select(
        *[F.col(c).alias(name) for c, name in zip(order, names, strict=True)],
        F.col("_place").alias("position"), (F.col("_place") % n_shards).cast("int").alias("shard"), F.expr(f"_place div {n_shards}").alias("slot"),
    )
