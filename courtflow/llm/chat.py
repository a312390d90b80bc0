"""Chat formatting of reply trees, by DataFrame operations only.

Iterative self-joins enumerate root-to-leaf paths: each join doubles the reach of every node's pointer to an
ancestor and adds up the scores on the way, so a path of d turns takes log2(d) joins. Leaves are ranked by
the score of their branch; the chosen leaves gather their ancestors by the same pointers, and each path
becomes one conversation:

    <|im_start|>role\\ntext<|im_end|>\\n   for each turn

Inside texts and roles a backslash is doubled and `<|` becomes `<\\|`; inside roles a line feed becomes
backslash, line feed. So control strings stand only where the template put them, and undoing an escape
means dropping the backslash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(column) -> F.Column:
    return F.replace(F.replace(column, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(column) -> F.Column:
    return F.replace(escape(column), F.lit("\n"), F.lit("\\\n"))


def unescape(column) -> F.Column:
    return F.regexp_replace(column, r"(?s)\\(.)", "$1")


def conversation_nodes(turns: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) as trees of one branch: each turn replies to the one before.

    Turns go by turn, then role, then text, so gaps in the numbers don't matter and repeated rows are turns of
    their own. A null role or text is empty. A null conv_id is a conversation too.
    """
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.row_number().over(by)
    return rows.select(
        F.col("conv_id").alias("tree_id"), n.cast("bigint").alias("node_id"), F.when(n > 1, n - 1).cast("bigint").alias("parent_id"),
        "role", "text", F.when(F.col("role") == "assistant", F.length("text")).otherwise(0).cast("double").alias("score"),
    )


def _pointers(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of pointers 1, 2, 4, ... nodes up, and of each node that hangs from a root its depth and branch score."""
    key = F.struct("tree_id", "node_id").alias("node")
    base = nodes.select(key, F.when(F.col("parent_id").isNotNull(), F.struct("tree_id", F.col("parent_id").alias("node_id"))).alias("up"), F.coalesce("score", F.lit(0.0)).alias("sum"))
    known = base.select(F.col("node").alias("up"), F.lit(True).alias("known"))
    now = base.join(known, "up", "left").select("node", F.when(F.col("known"), F.col("up")).alias("up"), "sum", F.lit(1).cast("bigint").alias("hops"))
    now = checkpoint(now)
    most, levels = now.count(), []
    while True:
        going = now.where("up is not null")
        if (1 << len(levels)) > max(1, most) or going.isEmpty():
            return levels, now.where("up is null")  # what still points after that many hops hangs from a circle
        levels.append(going.select("node", "up"))
        above = now.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("sum").alias("sum2"), F.col("hops").alias("hops2"))
        now = checkpoint(
            going.join(above, "up").select("node", F.col("up2").alias("up"), (F.col("sum") + F.col("sum2")).alias("sum"), (F.col("hops") + F.col("hops2")).alias("hops"))
            .unionByName(now.where("up is null"))
        )


def best_paths(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """The per_tree best root-to-leaf paths of each tree: (tree_id, leaf_id, rank, depth, role, text), a row a turn.

    nodes: tree_id, node_id (unique in its tree), parent_id (null: a root; so is a node whose parent isn't there),
    role, text, score (null: 0). A branch's score is the sum of its nodes'; ties go to the longer branch, then to
    the lower node_id. Nodes in or below a circle hang from no root and are on no path. Depth counts from 0. Other columns
    aren't read, so none can clash. An empty table gives an empty one. The nodes are written once, pointers carry keys only.
    """
    nodes = checkpoint(nodes.select("tree_id", "node_id", "parent_id", "role", "text", "score"))  # read three times
    levels, totals = _pointers(nodes)
    parents = nodes.where("parent_id is not null").select(F.struct("tree_id", F.col("parent_id").alias("node_id")).alias("node")).distinct()
    rank = F.row_number().over(Window.partitionBy("node.tree_id").orderBy(F.desc("sum"), F.desc("hops"), "node.node_id"))
    chosen = totals.join(parents, "node", "left_anti").withColumn("rank", rank).where(F.col("rank") <= per_tree)
    paths = checkpoint(chosen.select(F.col("node").alias("leaf"), "rank", "node", (F.col("hops") - 1).alias("depth")))
    for k in reversed(range(len(levels))):
        paths = checkpoint(paths.unionByName(paths.join(levels[k], "node").select("leaf", "rank", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))))
    said = nodes.select(F.struct("tree_id", "node_id").alias("node"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return paths.join(said, "node").select("leaf.tree_id", F.col("leaf.node_id").alias("leaf_id"), "rank", "depth", "role", "text")


def format_paths(paths: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row a path: tree_id, leaf_id, rank, formatted, loss_spans (array<struct<start,length>>, code points from 0).

    The spans cover the escaped texts of loss_role, one each, in order, without the template's own strings.
    """
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    turns = paths.select("tree_id", "leaf_id", "rank", "depth", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    turns = turns.withColumn("chars", F.length("head") + F.length("body") + len(END))
    before = F.sum("chars").over(Window.partitionBy("tree_id", "leaf_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("chars")
    span = F.when(F.col("role") == loss_role, F.struct((before + F.length("head")).cast("bigint").alias("start"), F.length("body").cast("bigint").alias("length")))
    rows = turns.select("tree_id", "leaf_id", "rank", "depth", F.concat("head", "body", F.lit(END)).alias("piece"), span.alias("span"))
    each = F.sort_array(F.collect_list(F.struct("depth", "piece", "span")))
    return rows.groupBy("tree_id", "leaf_id", "rank").agg(each.alias("each")).select(
        "tree_id", "leaf_id", "rank", F.array_join(F.transform("each", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("each", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def parse_turns(formatted) -> F.Column:
    """array<struct<role,text>> read back from a formatted conversation."""
    head = r"(?s)^<\|im_start\|>((?:[^\\\n]|\\.)*+)\n(.*)$"
    segments = F.slice(F.split(formatted, r"<\|im_end\|>\n"), 1, F.size(F.split(formatted, r"<\|im_end\|>\n")) - 1)
    return F.transform(segments, lambda s: F.struct(unescape(F.regexp_extract(s, head, 1)).alias("role"), unescape(F.regexp_extract(s, head, 2)).alias("text")))


def loss_text(formatted, spans) -> F.Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")
