"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points walk over the cumulative weights of the sources, each point is a slot of its
source, slots are ranked per source, and rank r takes the r-th block of equal token length from the
source's shuffled text line, which repeats once it is used up. The last block of a source is cut
so that its words meet the target exactly.

Sources may be as many as there are rows: their numbers, targets and intervals are tables, too.

Defined results: null texts have size 0 and a null source is a source of its own, last in order;
an empty table or one without words takes nothing; null ids count as values; repeated rows are counted
before anything is shuffled and get places of their own in any order among themselves; texts are
counted whole; columns not named are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.sharding import running_offsets
from tessera.llm.words import keyed_join, spread
from tessera.session import cut

#: Words in a block.
BLOCK = 1024
#: The golden-ratio walk runs on integers modulo 2^40, so that no point is rounded.
MOD_BITS = 40
GOLDEN = 679_556_692_463  # 2^40 / phi, made odd
#: Slots that are ranked together, rows of a source whose sizes one task adds up, sources that one task puts in order.
CHUNK = 1 << 16
RUN_ROWS = 5000
SOURCES = 100_000


def n_words(text: Column) -> Column:
    """Number of runs without ASCII white space; null counts as empty."""
    ws = " \t\n\x0b\f\r"
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(ws))
    return F.when(core == "", 0).otherwise(F.size(F.split(core, "[\\x20\\x09-\\x0D]+"))).cast("long")


def in_order(rows: DataFrame, order: list[Column], per_task: int = SOURCES) -> DataFrame:
    """Adds ``number``, the gapless place of each row in ``order``, and ``_part``: ranges of about ``per_task`` rows in that order."""
    parts = rows.count() // per_task + 1
    dealt = cut(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    offsets = running_offsets(dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")), "_part", "_n")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_in", within).join(offsets, "_part").withColumn("number", F.col("_in") + F.col("_offset")).drop("_in", "_offset")


def with_targets(sources: DataFrame, share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """Adds ``target`` to rows with source_size and weight: the weight's part of ``share`` of all sizes, at most ``cap`` times source_size.

    What capped sources can't take is shared by weight among the rest until none is above its cap: a level rises,
    round by round, and each target is the level times the weight or the cap.
    """
    room, some = F.col("source_size") * F.lit(float(cap)), F.col("source_size") > 0
    total = float(sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first()["t"]) * share
    level, n_full = 0.0, -1
    while True:
        full = some & (F.lit(level) * F.col("weight") >= room) if n_full >= 0 else F.lit(False)
        r = sources.agg(F.count_if(full).alias("n"), F.sum(F.when(full, room)).alias("used"), F.sum(F.when(some & ~full, F.col("weight"))).alias("w")).first()
        if r["n"] == n_full or not r["w"]:
            break
        n_full, level = r["n"], (total - (r["used"] or 0.0)) / r["w"]
    full = F.lit(level) * F.col("weight") >= room
    return sources.withColumn("target", F.when(~some, F.lit(0.0)).when(full, room).otherwise(F.lit(level) * F.col("weight")))


def schedule(sources: DataFrame) -> DataFrame:
    """Rows (slot, source_no, rank): the first ``slots`` golden-ratio points that fall to each source (source_no, slots, _part).

    ``_part`` holds ranges of source_no. The interval of a source is proportional to its slots; any interval of one K-th
    is met within the first 3 K points (three-distance theorem), so 3 K points are enough. Points find their source by
    buckets of the interval, about four for each source.
    """
    spark = sources.sparkSession
    r = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    total, bits = r["t"], min(MOD_BITS, (4 * r["n"]).bit_length())
    offsets = running_offsets(sources.groupBy("_part").agg(F.sum("slots").alias("_n")), "_part", "_n")
    upto = F.sum("slots").over(Window.partitionBy("_part").orderBy("source_no"))
    edge = lambda c: F.floor(c.cast("decimal(20,0)") * F.lit(1 << MOD_BITS).cast("decimal(14,0)") / F.lit(max(total, 1)).cast("decimal(20,0)")).cast("long")
    spans = sources.withColumn("_upto", upto).join(offsets, "_part").withColumn("_upto", F.col("_upto") + F.col("_offset")).filter("slots > 0")
    spans = spans.select("source_no", "slots", edge(F.col("_upto") - F.col("slots")).alias("_lo"), edge(F.col("_upto")).alias("_hi"))
    buckets = cut(spans.withColumn("_bucket", F.explode(F.expr(f"sequence(shiftright(_lo, {MOD_BITS - bits}), shiftright(_hi - 1, {MOD_BITS - bits}))"))))
    low, high = F.col("slot") % (1 << 20), F.expr(f"slot div {1 << 20}") % (1 << 20)
    point = (low * F.lit(GOLDEN) + ((high * F.lit(GOLDEN % (1 << 20))) % (1 << 20)) * (1 << 20)) % (1 << MOD_BITS)
    points = spark.range(3 * total + 8 if total else 0).select(F.col("id").alias("slot")).withColumn("_point", point).withColumn("_bucket", F.shiftright("_point", MOD_BITS - bits))
    drawn = points.join(buckets, "_bucket").filter("_lo <= _point AND _point < _hi").select("slot", "source_no", "slots", F.expr(f"slot div {CHUNK}").alias("_chunk"))
    per_chunk = drawn.groupBy("_chunk", "source_no").agg(F.count(F.lit(1)).alias("_n"))
    before = running_offsets(per_chunk, "_chunk", "_n", ("source_no",))
    within = F.row_number().over(Window.partitionBy("_chunk", "source_no").orderBy("slot")) - 1
    ranked = drawn.withColumn("_in", within).join(before, ["_chunk", "source_no"]).withColumn("rank", F.col("_in") + F.col("_offset"))
    return ranked.filter("rank < slots").select("slot", "source_no", "rank")


def text_lines(rows: DataFrame, order: list[str], seed: int, n_rows: int) -> DataFrame:
    """Adds ``at``: where the words of each row and its copies begin on the shuffled line of its source (source_no).

    Rows (distinct, with ``copies``) are put into runs by leading bits of a keyed hash; sizes are added up inside a run and
    over the runs' sums, so that a source with any share of the rows is spread over many tasks.
    """
    runs = max(1, -(-n_rows // RUN_ROWS))
    key = F.xxhash64(F.lit(seed), *order)
    light = rows.withColumn("_run", F.pmod(F.shiftrightunsigned(key, 20), F.lit(runs))).withColumn("_key", key).withColumn("_all", F.col("size") * F.col("copies"))
    offsets = running_offsets(light.groupBy("source_no", "_run").agg(F.sum("_all").alias("_run_size")), "_run", "_run_size", ("source_no",))
    w = Window.partitionBy("source_no", "_run").orderBy("_key", *order).rowsBetween(Window.unboundedPreceding, -1)
    placed = light.withColumn("_first", F.coalesce(F.sum("_all").over(w), F.lit(0))).join(offsets, ["source_no", "_run"])
    return placed.withColumn("at", F.col("_offset") + F.col("_first")).drop("_run", "_key", "_all", "_first", "_offset")


def _mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, share: float, cap: float, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(rows of the mix, pieces): rows with _id, _source, _th, _crc, size, source_size, target and taken."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    light = docs.select(F.col(f"`{id_col}`").alias("_id"), F.struct(F.col(f"`{source_col}`").alias("v")).alias("_source"), n_words(text).alias("size"), F.crc32(text.cast("binary")).alias("_crc"), F.xxhash64(text).alias("_th"))
    # Short columns, so that texts are read and counted once; equal rows are one with their number.
    light = cut(light.groupBy(*light.columns).agg(F.count(F.lit(1)).alias("copies")))
    found = light.groupBy("_source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    placed = in_order(found, [F.col("_source.v").isNull(), F.col("_source.v")]).withColumnRenamed("number", "source_no")
    goals = with_targets(cut(placed.withColumn("weight", F.col("source_no") % 3 + 1)), share, cap).withColumn("_whole", F.floor(F.col("target") + 0.5))
    sources = cut(goals.withColumn("slots", F.expr(f"(_whole + {block - 1}) div {block}")))
    n_rows = sources.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("n")).first()["n"]
    rows = keyed_join(light, sources.select("_source", "_rows", "source_no", "source_size", "target", "_whole"), "_source", "_rows")
    lined = spread(cut(text_lines(rows, ["_id", "_th", "size"], seed, n_rows)), "copies", "_copy").withColumn("at", F.col("at") + F.col("_copy") * F.col("size"))
    # A row's words lie on the line at ``at`` and again each source_size later, up to the target.
    turns = spread(lined.filter("size > 0 AND _whole > 0").withColumn("_rounds", F.expr("(_whole - 1) div source_size + 1")), "_rounds", "_round")
    on_line = turns.withColumn("_from", F.col("at") + F.col("_round") * F.col("source_size")).filter("_from < _whole").withColumn("_to", F.least(F.col("_from") + F.col("size"), F.col("_whole")))
    cut_up = on_line.withColumn("rank", F.explode(F.expr(f"sequence(_from div {block}, (_to - 1) div {block})")))
    pieces = cut_up.join(schedule(sources.select("source_no", "slots", "_part")), ["source_no", "rank"]).select(
        "slot", "_id", "source_no", "at",
        (F.greatest(F.col("_from"), F.col("rank") * block) - F.col("_from")).alias("start"), (F.least(F.col("_to"), (F.col("rank") + 1) * block) - F.col("_from")).alias("end"),
    )
    # Rows with words have a place of their own on their source's line; rows without take nothing.
    taken = pieces.groupBy("source_no", "at").agg(F.sum(F.col("end") - F.col("start")).alias("_taken"), F.lit(True).alias("_some"))
    mixed = lined.withColumn("_some", F.col("size") > 0).join(taken, ["source_no", "at", "_some"], "left").withColumn("taken", F.coalesce("_taken", F.lit(0)).cast("long"))
    return mixed, pieces


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.0, cap: float = 3.0, block: int = BLOCK, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Returns the documents with size, source_size, target and taken, and the pieces that the slots take.

    Documents: ``id_col``, text_crc32, ``source_col``, size, source_size, target, taken. Pieces: slot, ``id_col``, start and
    end (half-open, in words of the document), so that writing pieces in slot order gives the mixed stream.
    """
    mixed, pieces = _mix(docs, id_col, text_col, source_col, share, cap, block, seed)
    result = mixed.select(F.col("_id").alias(id_col), F.col("_crc").alias("text_crc32"), F.col("_source.v").alias(source_col), "size", "source_size", "target", "taken")
    return result, pieces.select("slot", F.col("_id").alias(id_col), "start", "end")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space between kept."""
    ws = "\\x20\\x09-\\x0D"
    parts = F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), f"(?<=[{ws}])(?=[^{ws}])")
    return F.rtrim(F.array_join(F.slice(parts, F.lit(1), n.cast("int")), ""))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.0, cap: float = 3.0, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """The mix itself: each document as often as it's taken whole, and cut to its first words where a target ends in it.

    Documents that the mix doesn't take go; the columns are those of ``docs``. Equal rows count together. The rows come
    in no order: who wants the schedule's order reads the pieces of ``mix``.
    """
    mixed, _ = _mix(docs, id_col, text_col, source_col, share, cap, block, seed)
    # The user's columns stay in one struct, so that no name of theirs meets one of ours; one key for both sides, one shuffle of texts.
    key = F.struct("_id", "_th", "_source").alias("_k")
    per = mixed.groupBy(key).agg(F.sum("taken").alias("_taken"), F.max("size").alias("_size")).filter("_taken > 0")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = F.struct(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_th"), F.struct(F.col(f"`{source_col}`").alias("v")).alias("_source"))
    rows = docs.select(own.alias("_k"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).dropDuplicates(["_k"])
    times = rows.join(per, "_k").withColumn("_copies", F.expr("_taken div _size + if(_taken % _size > 0, 1, 0)"))
    copies = spread(times, "_copies", "_copy").withColumn("_words", F.least(F.col("_size"), F.col("_taken") - F.col("_copy") * F.col("_size")))
    whole = F.col("_row")[text_col]
    text = F.when(F.col("_words") < F.col("_size"), first_words(whole, F.col("_words"))).otherwise(whole)
    return copies.select(*[text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])
