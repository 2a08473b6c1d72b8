"""Chat formatting of reply trees with DataFrame functions only.

A table of messages (tree, node, parent, role, text, score) is a forest. Iterative self-joins that
double the reach each time list the ancestors of every leaf, so a path of d messages takes
log2(d) joins. Branches are ranked by score on identifiers alone, then the texts of the chosen paths
are joined, and each path is written as one conversation with a reversible escape and character spans
for the loss.

Defined results: null texts and roles count as empty, null scores as 0; a null tree is a tree like any
other; messages whose parent is missing are roots; a node that is given several times is one message,
with the least parent, the highest score, and the least role and text; replies in a cycle have no root,
so those and the replies below them are left out; turns of a conversation that are repeated in the
table are all kept, ordered by role and text; texts are taken whole; a table without rows gives none;
other columns are ignored, whatever their names. One output row holds a whole conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

#: The template's marks, and other common control strings that texts mustn't hold raw.
START, END = "<|im_start|>", "<|im_end|>"
CONTROL = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: The escape character; texts that hold it have it doubled.
ESC = "\x1b"
_REST = "|".join("\\Q" + c[1:] + "\\E" for c in CONTROL)
#: Roles whose text is learnt.
LEARNT = ("assistant",)


def escaped(text: Column) -> Column:
    """``text`` without any control string; ``unescaped`` gives it back."""
    return F.regexp_replace(F.replace(text, F.lit(ESC), F.lit(ESC * 2)), f"([<\\[])(?={_REST})", f"$1{ESC}")


def unescaped(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, f"([<\\[]){ESC}(?={_REST})", "$1"), F.lit(ESC * 2), F.lit(ESC))


def escaped_role(role: Column) -> Column:
    """Roles end at a line feed, so theirs are escaped too."""
    return F.replace(escaped(role), F.lit("\n"), F.lit(ESC + "n"))


def unescaped_role(role: Column) -> Column:
    # A doubled escape followed by n is text: shield it while line feeds come back.
    shield = F.replace(role, F.lit(ESC * 2), F.lit(ESC + "e"))
    return F.replace(F.regexp_replace(F.replace(shield, F.lit(ESC + "n"), F.lit("\n")), f"([<\\[]){ESC}(?={_REST})", "$1"), F.lit(ESC + "e"), F.lit(ESC))


def chain_of_turns(turns: DataFrame, tree: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages in the order of ``order`` as a tree in which each replies to the one before."""
    w = Window.partitionBy("tree").orderBy("_order", "role", "text")
    rows = turns.select(F.col(tree).alias("tree"), F.col(order).alias("_order"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = rows.withColumn("node", F.row_number().over(w).cast("long"))
    return placed.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _keyed(messages: DataFrame, *columns: str) -> DataFrame:
    """The columns named, with the tree in a struct, so that joins find null trees as well."""
    return messages.select(F.struct(F.col("tree").alias("v")).alias("tree"), *columns)


def _links(messages: DataFrame) -> DataFrame:
    """One row for each node: (tree, node, parent, score)."""
    score = F.coalesce(F.col("score"), F.lit(0.0))
    return _keyed(messages, "node", "parent", score.alias("score")).groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.max("score").alias("score"))


def _leaf_paths(links: DataFrame) -> DataFrame:
    links = links.select("tree", "node", "parent")
    known = links.select("tree", F.col("node").alias("parent"))
    jumps = cut(links.join(known, ["tree", "parent"], "left_semi").select("tree", F.col("node").alias("from"), F.col("parent").alias("to")))
    inner = jumps.select("tree", F.col("to").alias("node")).distinct()
    paths = cut(links.join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")))
    roots = links.join(jumps.select("tree", F.col("from").alias("node")), ["tree", "node"], "left_anti").select("tree", "node")
    most = links.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    reach = 1
    while reach <= most:
        step = jumps.select("tree", F.col("from").alias("node"), "to")
        more = cut(paths.join(step, ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + reach).alias("up")))
        if more.isEmpty():
            return paths
        paths = paths.unionByName(more)
        further = jumps.select("tree", F.col("from").alias("to"), F.col("to").alias("last"))
        jumps = cut(jumps.join(further, ["tree", "to"]).select("tree", "from", F.col("last").alias("to")))
        reach *= 2
    # No path is longer than a tree has nodes: what goes on runs in a cycle.
    rooted = paths.join(roots, ["tree", "node"], "left_semi").select("tree", "leaf").distinct()
    return paths.join(rooted, ["tree", "leaf"], "left_semi").select("tree", "leaf", "node", "up")


def leaf_paths(messages: DataFrame) -> DataFrame:
    """Every root-to-leaf path: rows (tree, leaf, node, up), where ``up`` counts replies from node to leaf.

    Each round joins what is known within 2^k replies with the jumps of 2^k.
    """
    return _leaf_paths(_links(messages)).select(F.col("tree.v").alias("tree"), "leaf", "node", "up")


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The ``branches`` best paths of each tree by mean score, then length, then leaf; with their messages."""
    links = cut(_links(messages))
    paths = cut(_leaf_paths(links))
    rank = paths.join(links.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg("score").alias("_mean"), F.count(F.lit(1)).alias("_len"))
    order = Window.partitionBy("tree").orderBy(F.desc("_mean"), F.desc("_len"), "leaf")
    chosen = rank.withColumn("branch", F.row_number().over(order)).filter(F.col("branch") <= branches).select("tree", "leaf", "branch")
    said = _keyed(messages, "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    nodes = paths.join(chosen, ["tree", "leaf"]).join(said, ["tree", "node"])
    one = nodes.groupBy("tree", "leaf", "branch", "node", "up").agg(F.min(F.struct("role", "text")).alias("_m"))
    return one.select(F.col("tree.v").alias("tree"), "leaf", "branch", "node", "up", "_m.role", "_m.text")


def format_chats(messages: DataFrame, branches: int = 1, learnt: tuple[str, ...] = LEARNT) -> DataFrame:
    """One row for each chosen path: tree, branch, formatted and loss_spans.

    ``loss_spans`` are half-open code-point ranges of ``formatted``, one for each learnt text.
    """
    turns = best_paths(messages, branches).groupBy("tree", "branch").agg(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("_turns"))
    head = lambda t: F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n"))
    parts = turns.withColumn("_parts", F.transform("_turns", lambda t: F.struct(head(t).alias("head"), escaped(t["text"]).alias("body"), t["role"].isin(*learnt).alias("learn"))))
    tail = END + "\n"
    formatted = F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "")
    empty = F.expr("named_struct('at', 0L, 'spans', cast(array() AS array<struct<start: bigint, end: bigint>>))")

    def advance(state: Column, p: Column) -> Column:
        start = state["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(tail)).alias("at"), F.when(p["learn"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return parts.select("tree", "branch", formatted.alias("formatted"), F.aggregate("_parts", empty, advance, lambda s: s["spans"]).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.filter(F.split(formatted, "\\Q" + START + "\\E"), lambda x: x != "")
    cut_at = lambda x: F.instr(x, "\n")
    return F.transform(pieces, lambda x: F.struct(unescaped_role(F.substring(x, F.lit(1), cut_at(x) - 1)).alias("role"), unescaped(F.substring(x, cut_at(x) + 1, F.length(x) - cut_at(x) - len(END) - 1)).alias("text")))
