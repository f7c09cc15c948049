r"""Chat formatting over reply trees, with DataFrame functions only.

Input: nodes (tree_id, node_id, parent_id, role, text, score). Root-to-leaf paths are found by iterative self-joins that double the distance
covered: round k joins each node's 2**k-th ancestor to that one's own, which adds depths and scores on the way, so a tree of depth d
needs log2(d) rounds and never more rows than nodes. Leaves are ranked in their tree by the mean score of their path (ties: the
longer path, then the smaller leaf id); the chosen leaves' paths are listed by the same doubling, downwards, and each is formatted as one conversation.

Template: every turn is `<|role|>\n`, the text with escapes, `<|end|>\n`. In texts and roles `\` becomes `\\`, `<` becomes `\l` and `[` becomes `\b`, so no control
string of this template survives there, nor one of another that begins with `<` or `[`; in roles `|` becomes `\p`. The reverse turns them
back. The loss mask holds the assistants' texts. A conversation is one output string, so its turns come into one task: that group is the result itself.

Null texts and roles are empty; an unknown role stays as it is. A node whose parent is missing is a
root; equal (tree_id, node_id) rows must not occur, `conversation_nodes` numbers the turns to grant that. Turns with equal numbers are ordered by role and text.
An empty table gives only what is added to it. Extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

OPEN, NAMED, CLOSE = "<|", "|>\n", "<|end|>\n"


ESCAPES = {"<": "\\l", "[": "\\b", "|": "\\p"}


def escape(text: Column, marks: str = "<[") -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for m in marks:
        out = F.replace(out, F.lit(m), F.lit(ESCAPES[m]))
    return out


def unescape(text: Column) -> Column:
    """Left to right: split at escaped backslashes first, so that `\\\\l` gives `\\l`."""

    def back(p: Column) -> Column:
        for m, x in ESCAPES.items():
            p = F.replace(p, F.lit(x), F.lit(m))
        return p

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), back), "\\")


def conversation_nodes(turns: DataFrame) -> DataFrame:
    """Conversations as trees of one branch: each turn replies to the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node_id"))
    return numbered.select(
        F.col("conv_id").alias("tree_id"),
        "node_id",
        F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.lit(1.0).alias("score"),
    )


def root_to_leaf_paths(nodes: DataFrame, branches: int = 1, max_rounds: int = 40) -> DataFrame:
    """(tree_id, leaf_id, rank, pos, node_id): the nodes of the `branches` best paths of each tree, pos 0 at the root."""
    links = shared.cut(nodes.select("tree_id", "node_id", "parent_id", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")), "links")
    ids = links.select(F.col("tree_id").alias("t"), F.col("node_id").alias("p"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    # a parent that does not exist makes a root
    up = links.join(ids, same("tree_id", "t") & (F.col("parent_id") == F.col("p")), "left").select(
        "tree_id", "node_id", F.col("p").alias("anc"), F.when(F.col("p").isNotNull(), 1).otherwise(0).cast("long").alias("depth"), F.col("score").alias("total")
    )
    hops, done = [], None
    for _ in range(max_rounds):
        state = shared.cut(up, "up")
        rooted, live = state.where("anc IS NULL"), state.where("anc IS NOT NULL")
        done = rooted if done is None else done.unionAll(rooted)
        if not live.limit(1).count():
            break
        # only nodes that have not met their root go on; a short tree's nodes are out of the joins after few rounds
        hops.append(live)
        far = done.unionAll(live).select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), F.col("anc").alias("anc2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        up = live.join(far, same("tree_id", "t") & (F.col("anc") == F.col("n"))).select(
            "tree_id", "node_id", F.col("anc2").alias("anc"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("total") + F.col("total2")).alias("total")
        )
    else:
        raise ValueError("replies form a cycle or a path longer than 2**max_rounds")
    parents = links.where("parent_id IS NOT NULL").select(F.col("tree_id").alias("t"), F.col("parent_id").alias("p")).distinct()
    leaves = done.join(parents, same("tree_id", "t") & (F.col("node_id") == F.col("p")), "left_anti")
    # the best of each tree by a partial aggregate where one branch is asked for: a tree with very many leaves is not one task's
    worth = F.struct((-F.col("total") / (F.col("depth") + 1)).alias("cost"), (-F.col("depth")).alias("short"), F.col("node_id").alias("leaf"), F.col("depth").alias("depth"))
    if branches == 1:
        best = leaves.groupBy("tree_id").agg(F.min(worth).alias("w")).select("tree_id", F.lit(1).alias("rank"), "w.leaf", "w.depth")
    else:
        w = Window.partitionBy("tree_id").orderBy("w")
        best = leaves.select("tree_id", worth.alias("w")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= branches).select("tree_id", "rank", "w.leaf", "w.depth")
    path = best.select("tree_id", F.col("leaf").alias("leaf_id"), "rank", F.col("depth").alias("pos"), F.col("leaf").alias("node_id"))
    for k in reversed(range(len(hops))):  # each listed node adds its 2**k-th ancestor
        jump = hops[k].select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), "anc")
        more = path.join(jump, same("tree_id", "t") & (F.col("node_id") == F.col("n"))).select("tree_id", "leaf_id", "rank", (F.col("pos") - (1 << k)).alias("pos"), F.col("anc").alias("node_id"))
        path = shared.cut(path.unionAll(more), "path")
    return path


def format_conversations(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree_id, leaf_id, rank, n_turns, formatted, mask): mask is an array of (start, length) in code points of `formatted`, one for each assistant text."""
    nodes = shared.cut(nodes, "nodes")
    path = root_to_leaf_paths(nodes, branches)
    texts = nodes.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), "role", "text")
    turns = path.join(texts, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node_id") == F.col("n")))
    body = escape(F.col("text"))
    head = F.concat(F.lit(OPEN), escape(F.col("role"), "<[|"), F.lit(NAMED))
    one = F.struct("pos", head.alias("head"), body.alias("body"), (F.col("role") == "assistant").alias("loss"))
    convs = turns.groupBy("tree_id", "leaf_id", "rank").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    length = lambda t: F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)
    empty = F.array().cast("array<struct<start:long,length:long>>")
    walked = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), empty.alias("mask")),
        lambda a, t: F.struct(
            (a["at"] + length(t)).cast("long").alias("at"),
            F.when(t["loss"], F.concat(a["mask"], F.array(F.struct((a["at"] + F.length(t["head"])).cast("long").alias("start"), F.length(t["body"]).cast("long").alias("length"))))).otherwise(a["mask"]).alias("mask"),
        ),
    )
    return convs.select(
        "tree_id",
        "leaf_id",
        "rank",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"),
        walked["mask"].alias("mask"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    parts = F.split(formatted, r"<\|end\|>\n", -1)

    def turn(p: Column) -> Column:
        at = F.position(F.lit(NAMED), p)
        return F.struct(
            unescape(F.substr(p, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("role"),
            unescape(F.substr(p, at + len(NAMED))).alias("text"),
        )

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("x")).select("x.*")
    made = format_conversations(conversation_nodes(turns.unionByName(added)))
    back = made.withColumn("read", read_back(F.col("formatted")))
    learned = F.array_join(F.transform("mask", lambda m: unescape(F.substr("formatted", (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")
    out = back.withColumn("learned", learned)
    return out.select(
        F.col("tree_id").alias("conv_id"),
        "n_turns",
        F.sha2(F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
    sum(length(regexp_replace(text, '[\\<\[]', 'xx', 'g')) + length(regexp_replace(role, '[\\<\[|]', 'xx', 'g')) + 5 + 8) AS formatted_chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars,
  sha256(learned) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""
