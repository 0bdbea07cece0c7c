"""Chat formatting of reply trees, in DataFrame operations only.

Messages are nodes with a parent. Jump tables (ancestor at distance 1, 2, 4, ...) come
from joining a table with itself, so a tree of depth d takes log2(d) rounds; they give
every leaf its root, depth and path score. The leaves are the root-to-leaf paths, the
best ``branches`` per tree by score are kept, and walking the jump tables back from
the chosen leaves marks the messages of each path. Only ids and scores take part;
texts join at the end, once.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. In texts and roles a ``<``
followed by k > 0 bars gets one bar more, so no control string (one bar) can occur
there; a line break in a role becomes ``<|nl|>``. Both are undone on reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordscope.llm.common import pick
from ordscope.session import materialise

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
LEARN_FROM = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\|+)", r"<$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|(\|+)", r"<$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(BREAK))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(BREAK), F.lit("\n")))


# --- trees -----------------------------------------------------------------------


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Jump tables by doubling distance, and ``id, root, depth, total`` of the nodes that reach a root.

    ``nodes(tree, id, parent, score)``; ``total`` sums the scores from root to node.
    """
    tables = [materialise(nodes.where("parent IS NOT NULL").select("tree", "id", F.col("parent").alias("up")), "jump")]
    # far: the furthest ancestor seen, the distance to it, and the scores of the nodes below it.
    far = materialise(
        nodes.select(
            "tree", "id", F.coalesce("parent", "id").alias("far"), F.col("parent").isNotNull().cast("long").alias("depth"),
            F.when(F.col("parent").isNotNull(), F.col("score")).otherwise(F.lit(0.0)).alias("total"),
            F.col("parent").isNotNull().alias("moved"),
        ), "far",
    )
    n = nodes.count()
    rounds = 0
    # A path has at most n nodes; what still moves after log2(n) rounds is on a cycle.
    while rounds <= max(1, n).bit_length() and far.where("moved").limit(1).count():
        other = far.select(
            F.col("tree").alias("t"), F.col("id").alias("i"), F.col("far").alias("next"),
            F.col("depth").alias("more"), F.col("total").alias("plus"), F.col("moved").alias("goes_on"),
        )
        # Only nodes whose furthest ancestor is no root yet take part: in most trees few, after the first rounds.
        further = far.where("moved").join(other, F.col("tree").eqNullSafe(F.col("t")) & (F.col("far") == F.col("i"))).select(
            "tree", "id", F.col("next").alias("far"), (F.col("depth") + F.col("more")).alias("depth"),
            (F.col("total") + F.col("plus")).alias("total"), F.col("goes_on").alias("moved"),
        )
        far = materialise(far.where("NOT moved").unionAll(further), "far")
        last = tables[-1]
        again = last.select(F.col("tree").alias("t"), F.col("id").alias("i"), F.col("up").alias("next"))
        tables.append(
            materialise(last.join(again, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("i"))).select("tree", "id", F.col("next").alias("up")), "jump")
        )
        rounds += 1
    roots = nodes.where("parent IS NULL").select(F.col("tree").alias("t"), F.col("id").alias("root"), F.col("score").alias("first"))
    reached = far.join(roots, F.col("tree").eqNullSafe(F.col("t")) & (F.col("far") == F.col("root"))).select(
        "tree", "id", "root", "depth", (F.col("total") + F.col("first")).alias("total")
    )
    return tables, materialise(reached, "reached")


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``tree, root, branch, id, depth``: the messages of the ``branches`` best root-to-leaf paths of each root.

    ``messages(tree, id, parent, score)`` with unique (tree, id). A path's score is
    the mean of its messages' scores; ties go to the longer path, then the smaller
    leaf. A message whose parent is null, itself or missing is a root. Messages on a
    cycle hang from no root and are on no path.
    """
    ids = messages.select(F.col("tree").alias("t"), F.col("id").alias("i"))
    parent = F.when(F.col("parent") == F.col("id"), F.lit(None)).otherwise(F.col("parent"))
    linked = messages.select("tree", "id", parent.alias("p"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    nodes = linked.join(ids, F.col("tree").eqNullSafe(F.col("t")) & (F.col("p") == F.col("i")), "left")
    nodes = materialise(nodes.select("tree", "id", F.col("i").alias("parent"), "score"), "nodes")
    tables, reached = _jumps(nodes)
    inner = nodes.where("parent IS NOT NULL").select(F.col("tree").alias("t"), F.col("parent").alias("i")).distinct()
    leaves = reached.join(inner, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i")), "left_anti")
    rank = Window.partitionBy("tree", "root").orderBy(
        (F.col("total") / (F.col("depth") + 1)).desc(), F.col("depth").desc(), F.col("id")
    )
    chosen = leaves.withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= branches)
    marked = materialise(chosen.select("tree", "root", "branch", "id"), "marked")
    for table in reversed(tables):  # marked nodes and their ancestors at each power of two: all ancestors in the end
        up = table.select(F.col("tree").alias("t"), F.col("id").alias("i"), "up")
        above = marked.join(up, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i"))).select("tree", "root", "branch", F.col("up").alias("id"))
        marked = materialise(marked.unionAll(above), "marked")  # read twice by the next round
    depth = reached.select(F.col("tree").alias("t"), F.col("id").alias("i"), "depth")
    return marked.join(depth, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i"))).select("tree", "root", "branch", "id", "depth")


# --- rendering -------------------------------------------------------------------------


def render(turns: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., formatted, loss_mask``: one conversation per key from ``turns(keys, pos, role, text)``.

    ``loss_mask`` is an array of (start, end) in code points of ``formatted``: the
    escaped texts of the assistant's turns. A conversation is one value, so its size
    is bounded by what a row may hold.
    """
    role, text = escape_role(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    rows = turns.select(*keys, "pos", head.alias("head"), text.alias("body"), (F.col("role") == LEARN_FROM).alias("learn"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    order = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("from", F.coalesce(F.sum(F.length("piece")).over(order), F.lit(0)) + F.length("head"))
    span = F.when(F.col("learn"), F.struct(F.col("from").alias("start"), (F.col("from") + F.length("body")).alias("end")))
    turn = F.struct("pos", "piece", span.alias("span"))
    grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.select(
        *keys,
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.array_compact(F.transform("turns", lambda t: t["span"])).alias("loss_mask"),
    )


def format_trees(
    messages: DataFrame,
    tree_col: str = "tree",
    id_col: str = "id",
    parent_col: str = "parent",
    role_col: str = "role",
    text_col: str = "text",
    score_col: str = "score",
    branches: int = 1,
) -> DataFrame:
    """``tree, root, branch, formatted, loss_mask``: each chosen path as one conversation.

    Null roles and texts are empty, null scores 0; (tree, id) must be unique and ids
    not null; a null tree is a tree of its own. An empty table gives an empty result.
    """
    rows = pick(messages, tree=tree_col, id=id_col, parent=parent_col, role=role_col, text=text_col, score=score_col)
    paths = best_paths(rows.select("tree", "id", "parent", "score"), branches)
    said = rows.select(F.col("tree").alias("t"), F.col("id").alias("i"), "role", "text")
    turns = paths.join(said, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i")))
    return render(turns.withColumn("pos", F.col("depth")), ["tree", "root", "branch"])


def threads(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Linear conversations as trees: every turn replies to the one before it.

    ``tree, id, parent, role, text, score`` with all scores equal. Turns that repeat a
    number follow in order of role and text, null turns come first.
    """
    rows = pick(conversations, tree=conv_col, turn=turn_col, role=role_col, text=text_col)
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = rows.withColumn("id", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("id") > 1, F.col("id") - 1)
    return rows.select("tree", "id", parent.alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns array<struct<role, text>>`` and ``learned`` (the text under the loss mask), both unescaped."""
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    bodies = F.slice(pieces, F.lit(1), F.size(pieces) - 1)  # what follows the last end is empty

    def turn(piece: Column) -> Column:
        whole = F.substring(piece, F.lit(len(START) + 1), F.length(piece))
        cut = F.instr(whole, "\n")
        return F.struct(
            unescape_role(F.substring(whole, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substring(whole, cut + 1, F.length(whole))).alias("text"),
        )

    masked = F.transform(
        "loss_mask", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    )
    return formatted.withColumn("turns", F.transform(bodies, turn)).withColumn("learned", F.array_join(masked, ""))
