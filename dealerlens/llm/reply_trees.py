"""Chat formatting: reply trees, their root-to-leaf paths, and one conversation per chosen path."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealerlens.llm.common import save

# The template's marks.
TURN, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"


def escape(text: Column) -> Column:
    """Backslashes are doubled and ``<|`` becomes ``<\\|``: no mark survives inside a text."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(LINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(LINE), F.lit("\n")))


def linear_tree(rows: DataFrame, tree: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Conversations stored as numbered turns, as reply trees: each row answers the one before.

    Rows of equal turn (repeats) follow one another by role and text; a null
    turn comes first, null roles and texts are empty.  Returns tree, node,
    parent, score, role, text.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    base = rows.select(F.col(tree).alias("tree"), F.col(turn).alias("_turn"), role.alias("role"), text.alias("text"))
    w = Window.partitionBy("tree").orderBy(F.col("_turn").asc_nulls_first(), "role", "text")
    return (base.withColumn("node", F.row_number().over(w).cast("long"))
            .select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
                    F.lit(0.0).alias("score"), "role", "text"))


def best_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """Paths from a root to the ``top`` best leaves of each tree.

    ``nodes``: tree, node (unique in its tree), parent, score.  A node whose
    parent is null or absent is a root.  A leaf's rank is the mean score along
    its path (null scores count 0), then the smaller node.  Iterative
    self-joins double the distance that is jumped, so a chain of d replies
    takes about log2(d) rounds, each written to the shared folder.  Nodes on or
    below a cycle reach no root and are on no path.  A null tree is one tree.

    Returns tree, leaf, rank, node, depth (0 at the root).
    """
    n = nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).where("node is not null")
    up = n.select(F.col("tree").alias("_t"), F.col("node").alias("_p"))
    jump = save(n.join(up, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("parent") == F.col("_p")), "left")
                .select("tree", "node", F.col("_p").alias("anc"), F.lit(1).cast("long").alias("far"), "score"), "jump")
    size, open_rows = jump.agg(F.count("*"), F.count("anc")).first()
    first, jumps = jump, [jump]
    for _ in range(math.ceil(math.log2(size + 1)) + 1 if size else 0):
        if not open_rows:
            break
        todo, done = jump.where("anc is not null"), jump.where("anc is null")
        step = jump.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("anc").alias("_a"), F.col("far").alias("_f"), F.col("score").alias("_s"))
        jump = save(todo.join(step, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("anc") == F.col("_n")))
                    .select("tree", "node", F.col("_a").alias("anc"), (F.col("far") + F.col("_f")).alias("far"), (F.col("score") + F.col("_s")).alias("score"))
                    .unionAll(done), "jump")
        jumps.append(jump)
        open_rows = jump.agg(F.count("anc")).first()[0]
    # Rooted nodes: far is the number of nodes of the path down from the root.
    rooted = jump.where("anc is null")
    kids = first.where("anc is not null").select(F.col("tree").alias("_t"), F.col("anc").alias("_n")).distinct()
    leaves = rooted.join(kids, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy((F.col("score") / F.col("far")).desc(), "node"))
    chosen = save(leaves.withColumn("rank", rank).where(F.col("rank") <= top)
                  .select("tree", F.col("node").alias("leaf"), "rank", "node", (F.col("far") - 1).alias("depth")), "leaf")
    # jumps[k] leads 2**k replies up: each round doubles the stretch of path that is listed.
    path = chosen
    for k, table in enumerate(jumps):
        step = table.where((F.col("far") == 2 ** k) & F.col("anc").isNotNull()).select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("anc").alias("_a"))
        higher = (path.join(step, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")))
                  .select("tree", "leaf", "rank", F.col("_a").alias("node"), (F.col("depth") - 2 ** k).alias("depth")))
        path = save(path.unionAll(higher), "path")
    return path


def format_paths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """One formatted conversation per path: tree, leaf, rank, formatted, loss_spans.

    ``nodes`` has role and text (nulls are empty).  A turn is written
    ``<|im_start|>role`` newline ``text<|im_end|>`` newline, escaped.
    ``loss_spans`` holds (start, length) in code points of every assistant
    text inside ``formatted``, in order.
    """
    t = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turn = paths.join(t, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")))
    head = F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n"))
    turn = turn.select("tree", "leaf", "rank", "depth", (F.col("role") == "assistant").alias("loss"), head.alias("head"), escape(F.col("text")).alias("body"))
    turn = turn.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    before = F.sum(F.length("piece")).over(Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1))
    turn = turn.withColumn("start", F.coalesce(before, F.lit(0)) + F.length("head"))
    parts = F.array_sort(F.collect_list(F.struct("depth", "piece", "loss", "start", F.length("body").alias("length"))))
    spans = F.transform(F.filter("parts", lambda p: p["loss"]), lambda p: F.struct(p["start"].cast("long").alias("start"), p["length"].cast("long").alias("length")))
    return (turn.groupBy("tree", "leaf", "rank").agg(parts.alias("parts"))
            .select("tree", "leaf", "rank", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"), spans.alias("loss_spans")))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text) and loss (the unescaped text under the loss mask), from the formatted text alone."""
    pieces = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        cut = F.instr(p, "\n")
        role = p.substr(F.lit(1), cut - 1)
        text = p.substr(cut + 1, F.length(p) - cut - len(END) - 1)
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    masked = F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr(s["start"].cast("int") + 1, s["length"].cast("int"))))
    return formatted.withColumn("turns", F.transform(pieces, turn)).withColumn("loss", F.array_join(masked, ""))


def digest(formatted: DataFrame) -> DataFrame:
    back = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
