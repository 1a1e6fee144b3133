"""Conversations from reply trees.

Every root-to-leaf path of a reply tree is found by iterative self-joins. Each node knows an ancestor
and the sum of the scores up to it; a join with the ancestor's own row doubles the distance, so that
the joins grow with the logarithm of the depth. The paths of a tree are ranked by score, and the
nodes of each chosen path are found by the same steps in reverse and become one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.common import durable

#: Branches of a tree that become conversations: all with a rank up to this.
TOP = 3
END = "<|end|>"


def threads(turns: DataFrame) -> DataFrame:
    """Reply-tree nodes from a table of turns: ``tree``, ``node``, ``parent``, ``role``, ``text``,
    ``score``.

    The table names no parents, so replies are dealt by rule: node k of a conversation answers node
    k - 1, but where (conversation + k) is divisible by 3 and k > 3 it is a rival of node k - 2 and
    answers node k - 3. The score of a turn is the share of its words that are distinct, 0 for a
    null or blank text. Rows with a null conversation or turn are dropped; nodes are numbered from 1
    by turn, role and text, nulls first, and equal rows are one node.
    """
    rows = turns.select("conv_id", "turn", "role", "text").where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = rows.withColumn("node", F.row_number().over(order))
    back = F.when((F.col("node") > 3) & (F.pmod(F.col("conv_id") + F.col("node"), F.lit(3)) == 0), 3).otherwise(1)
    parent = F.when(F.col("node") > 1, F.col("node") - back)
    said = F.trim(F.coalesce("text", F.lit("")))
    words = F.split(said, " ")
    score = F.when(said == "", 0.0).otherwise(F.size(F.array_distinct(words)) / F.size(words))
    return rows.select(F.col("conv_id").alias("tree"), "node", parent.alias("parent"), "role", "text", score.alias("score"))


def message(role: str, text: str) -> Column:
    tag = F.concat(F.lit("<|"), F.lower(F.coalesce(F.col(role), F.lit("user"))), F.lit("|>\n"))
    return F.concat(tag, F.trim(F.coalesce(F.col(text), F.lit(""))), F.lit("\n" + END))


def single(nodes: DataFrame) -> DataFrame:
    """``tree``, ``node``, ``parent``, ``s`` (the score, 0 for null) and ``said`` of each node, once.

    Of several rows of one node the first by parent, score, role and text counts, nulls first. Rows
    with a null tree or node are dropped.
    """
    rows = nodes.where(F.col("tree").isNotNull() & F.col("node").isNotNull())
    one = rows.groupBy("tree", "node").agg(F.min(F.struct("parent", "score", "role", "text")).alias("o"))
    return one.select("tree", "node", "o.parent", F.coalesce("o.score", F.lit(0.0)).alias("s"), message("o.role", "o.text").alias("said"))


def climb(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``tree``, ``leaf``, ``depth`` and ``score`` (the mean of its nodes') of every root-to-leaf
    path of ``single`` nodes, and of each step ``tree``, ``node`` and ``up``, the ancestor at twice
    the distance of the step before."""
    state = durable(nodes.select("tree", "node", F.col("parent").alias("up"), "s", F.lit(1).alias("n")))
    active, steps = state.where("up IS NOT NULL").count(), []
    while active:
        steps.append(state.select("tree", "node", "up"))
        above = state.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("s").alias("more"), F.col("n").alias("nodes"))
        grown = state.join(above, ["tree", "up"], "left")
        state = durable(grown.select("tree", "node", F.col("next").alias("up"), (F.col("s") + F.coalesce("more", F.lit(0.0))).alias("s"), (F.col("n") + F.coalesce("nodes", F.lit(0))).alias("n")))
        left = state.where("up IS NOT NULL").count()
        if left == active:
            break  # what is left hangs on a cycle
        active = left
    inner = nodes.select("tree", F.col("parent").alias("node")).where("node IS NOT NULL").distinct()
    leaves = state.where("up IS NULL").join(inner, ["tree", "node"], "left_anti")
    return leaves.select("tree", F.col("node").alias("leaf"), F.col("n").alias("depth"), (F.col("s") / F.col("n")).alias("score")), steps


def along(chosen: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """A row for each node of each chosen path, with the path's columns, ``node`` and ``pos``, its
    place from the root, which is 1."""
    out = chosen.withColumns({"node": F.col("leaf"), "pos": F.col("depth")})
    for k in reversed(range(len(steps))):
        here, there = F.struct("node", "pos"), F.struct(F.col("up").alias("node"), (F.col("pos") - (1 << k)).alias("pos"))
        both = F.when(F.col("up").isNotNull() & (F.col("pos") > 1 << k), F.array(here, there)).otherwise(F.array(here))
        out = out.join(steps[k], ["tree", "node"], "left").select(*chosen.columns, F.explode(both).alias("at")).select(*chosen.columns, "at.node", "at.pos")
    return out


def paths(nodes: DataFrame) -> DataFrame:
    """``tree``, ``leaf``, ``depth``, ``score`` (mean of the nodes') and ``nodes`` (ids from the
    root) of every root-to-leaf path.

    A node without a parent, or whose parent is not there, is a root. Nodes of a cycle, and what
    hangs on them, are reached from no root and are on no path. Null scores count as 0. Repeated
    nodes as in ``single``; texts of any length, and columns beyond the nodes', are not read. An
    empty table gives an empty result.
    """
    leaves, steps = climb(single(nodes))
    rows = along(leaves, steps).groupBy("tree", "leaf", "depth", "score").agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("m"))
    return rows.select("tree", "leaf", "depth", "score", F.transform("m", lambda m: m["node"]).alias("nodes"))


def conversations(nodes: DataFrame, top: int = TOP) -> DataFrame:
    """``tree``, ``branch`` (its rank), ``leaf``, ``depth``, ``score`` and ``conversation`` of the
    best ``top`` paths of each tree.

    Paths rank by score, rounded to 9 places, then depth, both descending, then leaf. A null role
    counts as the user's, a null text as empty; texts of any length are used whole. Repeated nodes
    as in ``single``, cycles and missing parents as in ``paths``. Columns beyond the nodes' are
    ignored. An empty table gives an empty result.
    """
    one = durable(single(nodes))
    leaves, steps = climb(one)
    order = Window.partitionBy("tree").orderBy(F.desc(F.round("score", 9)), F.desc("depth"), "leaf")
    best = durable(leaves.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= top))
    said = along(best, steps).join(one.select("tree", "node", "said"), ["tree", "node"])
    ordered = F.array_sort(F.collect_list(F.struct("pos", "said")))
    out = said.groupBy("tree", "branch", "leaf", "depth", "score").agg(ordered.alias("m"))
    return out.select("tree", "branch", "leaf", "depth", F.round("score", 6).alias("score"), F.array_join(F.transform("m", lambda m: m["said"]), "\n").alias("conversation"))


#: The query over ``conversations`` in SQL.
SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id AS tree, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS INT) AS node, role, text
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
n AS (
  SELECT tree, node, role, text,
    CASE WHEN node > 1 THEN node - CASE WHEN node > 3 AND (tree + node) % 3 = 0 THEN 3 ELSE 1 END END AS parent,
    CASE WHEN trim(coalesce(text, '')) = '' THEN 0e0
         ELSE CAST(len(list_distinct(string_split(trim(coalesce(text, '')), ' '))) AS DOUBLE) / len(string_split(trim(coalesce(text, '')), ' ')) END AS s
  FROM t),
p AS (
  SELECT tree, node AS leaf, s AS total, 1 AS depth, '<|' || lower(coalesce(role, 'user')) || '|>' || chr(10) || trim(coalesce(text, '')) || chr(10) || '<|end|>' AS conversation
  FROM n WHERE parent IS NULL
  UNION ALL
  SELECT p.tree, n.node, p.total + n.s, p.depth + 1, p.conversation || chr(10) || '<|' || lower(coalesce(n.role, 'user')) || '|>' || chr(10) || trim(coalesce(n.text, '')) || chr(10) || '<|end|>'
  FROM p JOIN n ON n.tree = p.tree AND n.parent = p.leaf),
leaves AS (
  SELECT *, total / depth AS score FROM p
  WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.tree = p.tree AND n.parent = p.leaf)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY round(score, 9) DESC, depth DESC, leaf) AS branch FROM leaves)
SELECT tree, CAST(branch AS INT) AS branch, leaf, CAST(depth AS INT) AS depth, round(score, 6) AS score, conversation
FROM ranked WHERE branch <= 3
"""
