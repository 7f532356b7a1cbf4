"""Reply trees: root-to-leaf paths by iterative self-joins, ranked by score and formatted, in DataFrame expressions only.

Paths are found by pointer doubling: after k self-joins each node knows its ancestor 2**k steps up and the sum of the
scores on the way, so a tree of depth d takes log2(d) rounds, and every round is a written table. Leaves are ranked
within their tree; only chosen paths are spelt out, again by doubling.

The template writes a turn as ``<|im_start|>role\\n text<|im_end|>\\n`` (without the blank). Inside roles and texts a
backslash is doubled, every control string (of this template and of others) gets a backslash after its first character,
and a line feed in a role becomes ``\\:``; reading back undoes this exactly. loss_spans are [start, stop) in code points
of the formatted text, over the escaped texts of the loss roles.

Cases: null texts and roles are empty; a node whose parent is null or missing is a root; nodes in or below a cycle have no
root and no path; rows without a node id are no nodes; repeated (tree, node) rows are one node, placed by the smallest
(parent, score) and speaking the smallest (role, text), nulls first; null scores are 0 and NaN ranks last; ties in score go
to the smallest leaf, in the order of the ids' own type; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from typica.llm.common import discard, write_out

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings that no text may bring in.
CONTROLS = [START, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}")), CONTROLS, doubled)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\:"))


def unescape_role(role: Column) -> Column:
    """Doubled backslashes first split the text, so that a backslash before a colon is one that escape_role wrote."""
    parts = F.split(role, r"\\\\")
    return F.array_join(F.transform(parts, lambda x: unescape(F.replace(x, F.lit("\\:"), F.lit("\n")))), "\\")


def tree_paths(nodes: DataFrame, *, top: int | None = 1, by: str = "mean") -> DataFrame:
    """(tree, leaf, node, depth, rank, path_score): the nodes of each tree's best paths; depth 0 is the root.

    nodes: tree, node, parent, score; ids of any type with an order. by: mean or sum of the scores along the path. top: paths
    per tree, None for all.
    """
    once = nodes.where("node is not null").groupBy("tree", "node").agg(F.min(F.struct("parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))).alias("x"))
    nodes = once.select("tree", "node", "x.parent", "x.score")
    present = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    first = nodes.join(present, nodes["tree"].eqNullSafe(present["t"]) & (nodes["parent"] == present["n"]), "left")
    tables = [write_out(first.select("tree", "node", F.col("n").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("count")), "reply-up")]
    steps, rooted, n_open = [tables[0].where("up is not null")], tables[0].where("up is null"), None
    while True:  # nodes that know their root stay aside; the others double the way that they know
        still = steps[-1].count()
        if still == 0 or still == n_open:
            break
        n_open = still
        above = rooted.unionByName(steps[-1]).select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("count").alias("count2"))
        own = steps[-1].join(above, steps[-1]["tree"].eqNullSafe(above["t"]) & (steps[-1]["up"] == above["n"]))
        tables.append(write_out(own.select("tree", "node", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("count") + F.col("count2")).alias("count")), "reply-up"))
        rooted = rooted.unionByName(tables[-1].where("up is null"))
        steps.append(tables[-1].where("up is not null"))
    parents = steps[0].select(F.col("tree").alias("t"), F.col("up").alias("n")).distinct()
    leaves = rooted.join(parents, rooted["tree"].eqNullSafe(parents["t"]) & (rooted["node"] == parents["n"]), "left_anti")
    leaves = leaves.select("tree", F.col("node").alias("leaf"), (F.col("total") / F.col("count") if by == "mean" else F.col("total")).alias("path_score"), "count")
    if top == 1:  # combines before the shuffle, for trees with very many leaves
        best = leaves.groupBy("tree").agg(F.min(F.struct((-F.col("path_score")).alias("low"), "leaf", "path_score", "count")).alias("b"))
        leaves = best.select("tree", "b.leaf", "b.path_score", "b.count", F.lit(1).alias("rank"))
    else:
        rank = F.row_number().over(Window.partitionBy("tree").orderBy((-F.col("path_score")), "leaf"))
        leaves = leaves.withColumn("rank", rank)
        leaves = leaves if top is None else leaves.where(F.col("rank") <= top)
    paths = write_out(leaves.select("tree", "leaf", F.col("leaf").alias("node"), (F.col("count") - 1).alias("depth"), "rank", "path_score"), "reply-paths")
    for k in range(len(steps) - 2, -1, -1):  # no path takes the last step's jumps: it has none, or those of cycles
        jump = steps[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        more = paths.join(jump, paths["tree"].eqNullSafe(jump["t"]) & (paths["node"] == jump["n"])).select("tree", "leaf", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"), "rank", "path_score")
        paths = paths.unionByName(write_out(more, "reply-paths"))  # only the new nodes are written
    discard(*tables)
    return paths


def format_paths(paths: DataFrame, turns: DataFrame, *, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(tree, leaf, rank, path_score, formatted, loss_spans): one conversation per path.

    turns: tree, node, role, text. Offsets come from a running sum, so a long conversation costs no squares.
    """
    t = turns.groupBy(F.col("tree").alias("t"), F.col("node").alias("n")).agg(F.min(F.struct("role", "text")).alias("x"))
    rows = paths.join(t, paths["tree"].eqNullSafe(t["t"]) & (paths["node"] == t["n"]))
    head = F.concat(F.lit(START), escape_role(F.col("x.role")), F.lit("\n"))
    rows = rows.select("tree", "leaf", "rank", "path_score", "depth", head.alias("head"), escape(F.col("x.text")).alias("body"), F.coalesce(F.col("x.role").isin(*loss_roles), F.lit(False)).alias("loss"))
    w = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END) + 1
    rows = rows.withColumn("start", F.coalesce(F.sum(size).over(w), F.lit(0)) + F.length("head"))
    piece = F.struct("depth", F.concat("head", "body", F.lit(END + "\n")).alias("piece"), "start", (F.col("start") + F.length("body")).alias("stop"), "loss")
    path = rows.groupBy("tree", "leaf", "rank", "path_score").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    spans = F.transform(F.filter("p", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))
    return path.select("tree", "leaf", "rank", "path_score", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x, i: i > 0)
    tail = len(END) + 1

    def turn(x: Column) -> Column:
        head = F.substring_index(x, "\n", 1)
        body = x.substr(F.length(head) + 2, F.length(x) - F.length(head) - 1 - tail)
        return F.struct(unescape_role(head).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")


def chains(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text as trees of single replies: tree, node, parent, score, role, text; equal turns in order of role and text."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()))
    rows = conversations.select(F.col("conv_id").alias("tree"), place.cast("long").alias("node"), "role", "text")
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.coalesce(F.length("text"), F.lit(0)).alias("score"), "role", "text")
