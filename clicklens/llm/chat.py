"""Reply trees into training conversations, in SQL functions.

Messages point at their parents. Iterated self-joins double the distance that a pointer spans, so a tree of depth
d takes about log2(d) rounds. The pointers add up the scores from each leaf to its root, by which branches are
ranked, and enumerate the messages of the chosen branches. Each chosen path is written as one conversation by a
template that marks turns and escapes its own control characters inside texts, with the spans of the loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicklens.sources.tables import staged

# The template of a turn is ``### role: text</turn>`` and a line break. In an escaped text no ``#``, ``<`` or ``:``
# is left, so marks are found by plain search; every escape is a tilde and one letter, tildes included.
HEAD, COLON, END = "### ", ": ", "</turn>\n"
ESCAPES = [("~", "~t"), ("#", "~h"), ("<", "~l"), (":", "~c")]


def escape(text: Column) -> Column:
    """``text`` with the control characters of the template as escapes; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for raw, marked in ESCAPES:
        out = F.replace(out, F.lit(raw), F.lit(marked))
    return out


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: a tilde always begins an escape, and its own escape is undone last."""
    for raw, marked in reversed(ESCAPES):
        text = F.replace(text, F.lit(marked), F.lit(raw))
    return text


def _key(rows: DataFrame) -> DataFrame:
    """One row for each (tree, node): of repeated nodes, the least by parent, role, text and score."""
    rest = F.min(F.struct("parent", "role", "text", "score")).alias("m")
    return rows.filter("node IS NOT NULL").groupBy("tree", "node").agg(rest).select("tree", "node", "m.*")


def _pointers(nodes: DataFrame) -> list[DataFrame]:
    """Tables (tree, node, up, gain) of the ancestors 1, 2, 4, ... steps up; gain sums the scores on the way.

    The gain of a step is the score of the node that it leaves. A table holds the nodes that have such an
    ancestor. Without cycles the last one is empty; with cycles, whose members have ancestors without end, the
    tables end beyond the longest path that the messages left in them could form.
    """
    parents = nodes.select("tree", F.col("node").alias("up")).distinct()
    step = nodes.filter("parent IS NOT NULL").select("tree", "node", F.col("parent").alias("up"), F.col("score").alias("gain"))
    tables = [staged(step.join(parents, ["tree", "up"], "left_semi").select("tree", "node", "up", "gain"), "chat-up")]
    size = tables[0].count()
    reach = 1
    while size and reach <= size:  # a path without a cycle has no more steps than there are pointers
        last = tables[-1]
        further = last.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("gain").alias("gain2"))
        doubled = last.join(further, ["tree", "up"]).select(
            "tree", "node", F.col("up2").alias("up"), (F.col("gain") + F.col("gain2")).alias("gain")
        )
        tables.append(staged(doubled, "chat-up"))
        reach *= 2
        size = tables[-1].count()
    return tables


def reply_paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """(tree, leaf, rank, depth, node, role, text) of the best root-to-leaf paths of reply trees.

    ``messages`` has tree, node, parent, role, text and score. Branches are ranked per tree by the sum of their
    scores (null counts 0), ties by the smaller leaf, and the first ``branches`` are taken (all if None). depth
    counts from the root, which is 0. A message whose parent is null or missing is a root; messages on or
    below a cycle have no root and are on no path. Repeated nodes count once; a null node or tree is left out.
    """
    nodes = staged(_key(messages.filter("tree IS NOT NULL").withColumn("score", F.coalesce("score", F.lit(0.0)))), "chat-nodes")
    tables = _pointers(nodes)
    own = nodes.select("tree", "node", "score")
    leaves = own.join(
        tables[0].select("tree", F.col("up").alias("node")).distinct(), ["tree", "node"], "left_anti"
    ).select("tree", F.col("node").alias("leaf"), F.col("node").alias("at"), F.lit(0.0).alias("total"), F.lit(0).alias("steps"))
    # Climb from each leaf to its root by the long pointers first.
    for k in range(len(tables) - 1, -1, -1):
        jump = tables[k].select("tree", F.col("node").alias("at"), "up", "gain")
        climbed = leaves.join(jump, ["tree", "at"], "left")
        leaves = climbed.select(
            "tree",
            "leaf",
            F.coalesce("up", "at").alias("at"),
            (F.col("total") + F.coalesce("gain", F.lit(0.0))).alias("total"),
            (F.col("steps") + F.when(F.col("up").isNotNull(), 1 << k).otherwise(0)).alias("steps"),
        )
    order = Window.partitionBy("tree").orderBy(F.desc("total"), "leaf")
    roots = own.join(tables[0].select("tree", "node"), ["tree", "node"], "left_anti")
    roots = roots.select("tree", F.col("node").alias("at"), "score")
    ranked = leaves.join(roots, ["tree", "at"]).withColumn("total", F.col("total") + F.col("score"))
    ranked = ranked.select("tree", "leaf", "steps", F.row_number().over(order).alias("rank"))
    if branches is not None:
        ranked = ranked.filter(F.col("rank") <= branches)
    path = staged(ranked.select("tree", "leaf", "rank", F.col("leaf").alias("node"), F.col("steps").alias("depth")), "chat-path")
    # The ancestors of a leaf at every distance: each table doubles what the longer ones have laid out.
    for k in range(len(tables) - 1, -1, -1):
        jump = tables[k].select("tree", "node", "up")
        more = path.join(jump, ["tree", "node"]).select(
            "tree", "leaf", "rank", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth")
        )
        path = staged(path.unionByName(more), "chat-path")
    return path.join(nodes.select("tree", "node", "role", "text"), ["tree", "node"]).select(
        "tree", "leaf", "rank", "depth", "node", "role", "text"
    )


def format_paths(paths: DataFrame, learn: str = "assistant") -> DataFrame:
    """(tree, leaf, rank, formatted, loss_spans): one conversation per path of ``reply_paths``.

    loss_spans has the (start, end) code points, end exclusive, of the escaped texts of the ``learn`` role. Null
    roles and texts are written as empty ones.
    """
    head = F.concat(F.lit(HEAD), escape(F.col("role")), F.lit(COLON))
    turns = paths.select(
        "tree", "leaf", "rank", "depth", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == learn).alias("learn")
    ).withColumn("part", F.concat("head", "body", F.lit(END)))
    upto = Window.partitionBy("tree", "leaf", "rank").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("begin", F.coalesce(F.sum(F.length("part")).over(upto), F.lit(0)) + F.length("head"))
    span = F.struct(F.col("begin").alias("start"), (F.col("begin") + F.length("body")).alias("end"))
    rows = turns.groupBy("tree", "leaf", "rank").agg(
        F.sort_array(F.collect_list(F.struct("depth", "part"))).alias("parts"),
        F.sort_array(F.collect_list(F.when(F.col("learn"), span))).alias("loss_spans"),
    )
    return rows.select(
        "tree", "leaf", "rank", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("formatted"), "loss_spans"
    )


def read_turns(formatted: Column) -> Column:
    """Structs (role, text) of the turns of a formatted conversation."""
    parts = F.split(formatted, END)
    parts = F.slice(parts, 1, F.size(parts) - 1)  # nothing follows the last mark

    def turn(p: Column) -> Column:
        at = F.instr(p, COLON)
        role = F.substring(p, F.lit(len(HEAD) + 1), at - 1 - len(HEAD))
        return F.struct(unescape(role).alias("role"), unescape(F.substring(p, at + len(COLON), F.length(p))).alias("text"))

    return F.transform(parts, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), ""
    )


def conversation_messages(rows: DataFrame) -> DataFrame:
    """Reply trees of linear conversations (conv_id, turn, role, text): each row answers the one before it.

    Rows of a conversation follow by turn; equal turns by role and text, null first. Nothing is dropped, repeated rows stay.
    """
    order = Window.partitionBy("conv_id").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")])
    place = rows.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node"))
    return place.select(
        F.col("conv_id").alias("tree"),
        "node",
        F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )


def conversation_report(conversations: DataFrame) -> DataFrame:
    """What a reader of the formatted conversations gets back, as digests.

    Returns conv_id, n_turns, turns_sha256 (of role, line break, text, line break per turn), loss_chars and
    loss_sha256 (of the text under the loss mask) and formatted_chars for each conv_id of (conv_id, turn, role,
    text). Null roles and texts are empty, rows without a conv_id are left out, other columns are not read.
    """
    rows = format_paths(reply_paths(conversation_messages(conversations.filter("conv_id IS NOT NULL"))))
    read = rows.select(
        F.col("tree").alias("conv_id"),
        read_turns(F.col("formatted")).alias("turns"),
        read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
