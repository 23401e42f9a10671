"""Chat formatting of reply trees, with DataFrame functions only.

``reply_paths`` takes messages as nodes of reply trees. Two rounds of iterative self-joins do the work, both by
pointer doubling, so their number is the logarithm of the deepest tree and no join key is hotter than a node's
fan-out: the first finds every node's root, depth and score along its branch; the second walks from each chosen
leaf back to its root and so enumerates the nodes of the root-to-leaf path. Branches of one tree are ranked by
their mean message score (ties: the smaller leaf id) and the best ``branches`` are kept.

``format_paths`` writes each path as one string. Every turn opens with ``<s>``::

    user       <s>[INST]text[/INST]
    assistant  <s>text</s>
    other      <s>[ROLE]role[/ROLE]text</s>

Control strings inside texts and roles are escaped reversibly: a backslash is doubled, and a backslash is put
after the first character of every control string. ``loss_spans`` holds, per assistant turn, the turn's number
and the start and length (code points) of its text within the turn's part of the string, so that reading the
mask back stays linear in the string's length.

Defined results: null texts and roles are empty strings; a null score is 0; a node whose parent is null, missing
or itself is a root; nodes in a reply cycle reach no root and are left out; an empty table gives no rows; columns
besides the named ones are ignored, whatever their names. Repeated identical rows of ``conversations`` stay
separate turns, in an order given by turn, role and text (null turns first).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.session import cut, drop_cut

#: The template's control strings.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"]
_CONTROL_RE = r"(<|\[)(/?s>|/?INST\]|/?ROLE\])"
#: Turns are numbered by blocks of this many turn values, and joined to one string by as many.
BLOCK = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL_RE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chain(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as reply trees: (tree_id, node, parent, role, text, score), node counting from 0.

    Identical rows are pre-aggregated; the running count is taken over blocks of turn values and then inside
    each block, so that one conversation holding a third of all rows is not sorted in one task.
    """
    r = rows.select(
        F.col(conv).cast("long").alias("tree_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"),
    )
    r = r.where(F.col("tree_id").isNotNull()).groupBy("tree_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    r = r.withColumn("block", F.floor(F.col("turn") / BLOCK))
    from pyspark.sql import Window

    inside = Window.partitionBy("tree_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    r = r.withColumn("upto", F.sum("n").over(inside))
    blocks = r.groupBy("tree_id", "block").agg(F.sum("n").alias("m"))
    before = Window.partitionBy("tree_id").orderBy(F.col("block").asc_nulls_first())
    blocks = blocks.withColumn("before", F.sum("m").over(before) - F.col("m"))
    r = r.alias("r").join(
        blocks.alias("b"), F.col("r.tree_id").eqNullSafe(F.col("b.tree_id")) & F.col("r.block").eqNullSafe(F.col("b.block"))
    )
    last = F.col("b.before") + F.col("r.upto")
    node = F.explode(F.sequence(last - F.col("r.n"), last - 1))
    r = r.select("r.tree_id", node.alias("node"), "r.role", "r.text")
    parent = F.when(F.col("node") > 0, F.col("node") - 1)
    return r.select("tree_id", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def reply_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree_id, leaf, branch_rank, branch_score, node, depth) of the chosen root-to-leaf paths, depth from 0."""
    nodes = messages.select("tree_id", "node", F.when(F.col("parent") != F.col("node"), F.col("parent")).alias("parent"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("tree_id").alias("kt"), F.col("node").alias("kn"))
    nodes = nodes.join(known, (F.col("tree_id") == F.col("kt")) & (F.col("parent") == F.col("kn")), "left")
    # up: the ancestor 2**k steps above, null beyond the root; dist and total: steps and score of the nodes passed
    first = cut(nodes.select("tree_id", "node", F.col("kn").alias("up"), F.when(F.col("kn").isNull(), 0).otherwise(1).alias("dist"), F.col("score").alias("total")))
    parents = first.where(F.col("up").isNotNull()).select("tree_id", F.col("up").alias("node")).distinct()
    # nodes whose root is found leave the self-join; what is still open once 2**k passes the node count is in a cycle
    ends, jumps, n_nodes = first.where(F.col("up").isNull()), [first.where(F.col("up").isNotNull())], first.count()
    while 2 ** (len(jumps) - 1) <= n_nodes and jumps[-1].limit(1).count():
        a, b = jumps[-1].alias("a"), jumps[-1].unionByName(ends).alias("b")
        step = a.join(b, (F.col("a.tree_id") == F.col("b.tree_id")) & (F.col("a.up") == F.col("b.node"))).select(
            "a.tree_id", "a.node", F.col("b.up").alias("up"), (F.col("a.dist") + F.col("b.dist")).alias("dist"), (F.col("a.total") + F.col("b.total")).alias("total")
        )
        step = cut(step)
        ends = ends.unionByName(step.where(F.col("up").isNull()))
        jumps.append(step.where(F.col("up").isNotNull()))
    leaves = ends.join(parents, ["tree_id", "node"], "left_anti")
    score = F.col("total") / (F.col("dist") + 1)
    # the best branches of a tree: a bounded heap per task first, so a tree with very many leaves is no hot group
    pick = F.struct((-score).alias("s"), F.col("node").alias("leaf"), F.col("dist").alias("d"))
    if branches == 1:
        best = leaves.groupBy("tree_id").agg(F.min(pick).alias("p")).withColumn("branch_rank", F.lit(1))
    else:
        from pyspark.sql import Window

        salted = Window.partitionBy("tree_id", F.pmod(F.xxhash64("node"), F.lit(64))).orderBy("p")
        near = leaves.select("tree_id", "node", pick.alias("p")).withColumn("i", F.row_number().over(salted)).where(F.col("i") <= branches)
        best = near.withColumn("branch_rank", F.row_number().over(Window.partitionBy("tree_id").orderBy("p"))).where(F.col("branch_rank") <= branches)
    chosen = best.select("tree_id", F.col("p.leaf").alias("leaf"), "branch_rank", (-F.col("p.s")).alias("branch_score"), F.col("p.leaf").alias("node"), F.col("p.d").alias("depth"))
    for k, jump in enumerate(jumps):
        c, j = chosen.alias("c"), jump.alias("j")
        above = c.join(j, (F.col("c.tree_id") == F.col("j.tree_id")) & (F.col("c.node") == F.col("j.node")))
        chosen = chosen.unionByName(above.select("c.tree_id", "c.leaf", "c.branch_rank", "c.branch_score", F.col("j.up").alias("node"), (F.col("c.depth") - 2**k).cast("int").alias("depth")))
        if k < len(jumps) - 1 and k % 3 == 2:
            chosen = cut(chosen)
    return chosen


def format_paths(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """(tree_id, leaf, branch_rank, branch_score, n_turns, text, loss_spans): one row per chosen path."""
    m, p = messages.alias("m"), paths.alias("p")
    t = p.join(m, (F.col("p.tree_id") == F.col("m.tree_id")) & (F.col("p.node") == F.col("m.node"))).select(
        "p.tree_id", "p.leaf", "p.branch_rank", "p.branch_score", "p.depth",
        F.coalesce("m.role", F.lit("")).alias("role"), escape(F.coalesce("m.text", F.lit(""))).alias("body"),
    )
    said = F.col("role") == "assistant"
    part = (
        F.when(F.col("role") == "user", F.concat(F.lit("<s>[INST]"), "body", F.lit("[/INST]")))
        .when(said, F.concat(F.lit("<s>"), "body", F.lit("</s>")))
        .otherwise(F.concat(F.lit("<s>[ROLE]"), escape(F.col("role")), F.lit("[/ROLE]"), "body", F.lit("</s>")))
    )
    span = F.when(said, F.struct(F.col("depth").alias("turn"), F.lit(3).alias("start"), F.length("body").alias("length")))
    t = t.select("tree_id", "leaf", "branch_rank", "branch_score", "depth", part.alias("part"), span.alias("span"))
    key = ["tree_id", "leaf", "branch_rank", "branch_score"]
    # two levels: blocks of turns become strings first, so the last aggregate of a long path holds few, compact rows
    ordered = F.array_sort(F.collect_list(F.struct("depth", "part", "span")))
    blocks = t.groupBy(*key, F.floor(F.col("depth") / BLOCK).alias("block")).agg(ordered.alias("x")).select(
        *key, "block", F.size("x").alias("n"), F.concat_ws("", "x.part").alias("part"), F.filter("x.span", lambda s: s.isNotNull()).alias("spans")
    )
    joined = F.array_sort(F.collect_list(F.struct("block", "part", "spans")))
    return blocks.groupBy(*key).agg(F.sum("n").alias("n_turns"), joined.alias("x")).select(
        *key, "n_turns", F.concat_ws("", "x.part").alias("text"), F.flatten("x.spans").alias("loss_spans")
    )


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """messages (tree_id, node, parent, role, text, score) to one formatted conversation per chosen branch."""
    messages = cut(messages)
    return format_paths(reply_paths(messages, branches), messages)


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns and the text under the loss mask, read from the strings alone."""
    parts = F.slice(F.split("text", "<s>"), 2, 2**31 - 1)

    def turn(p: Column) -> Column:
        user = p.startswith("[INST]")
        other = p.startswith("[ROLE]")
        role = F.when(user, F.lit("user")).when(other, F.regexp_extract(p, r"(?s)^\[ROLE\](.*?)\[/ROLE\]", 1)).otherwise(F.lit("assistant"))
        body = (
            F.when(user, F.regexp_replace(p, r"(?s)^\[INST\](.*)\[/INST\]\z", "$1"))
            .when(other, F.regexp_replace(p, r"(?s)^\[ROLE\].*?\[/ROLE\](.*)</s>\z", "$1"))
            .otherwise(F.regexp_replace(p, r"(?s)</s>\z", ""))
        )
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.get("parts", s["turn"]), s["start"] - 2, s["length"])))
    return (
        formatted.withColumn("parts", parts)
        .withColumn("turns", F.transform("parts", turn))
        .withColumn("loss_text", F.concat_ws("", masked))
        .drop("parts")
    )


def conversation_digest(conversations: DataFrame) -> DataFrame:
    """The digest columns of formatted, read-back conversations."""
    back = read_back(format_trees(chain(conversations)))
    joined = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
    )
