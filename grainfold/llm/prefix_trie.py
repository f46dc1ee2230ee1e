"""The trie of conversations' prefixes, with subtree sums by heavy-path decomposition.

A node is a distinct sequence of first turns. It is known by two 64-bit hashes, each the exclusive or of hashes of
(place, turn) along the sequence, so that a running window makes the keys of all prefixes and a node's parent is known
without a search; texts are hashed before anything is shuffled. Each node's largest child (most members, then the
largest key) is its heavy child. A heavy path ends in a leaf and is a stretch of the smallest conversation that ends
there, so one window over these conversations finds all paths and, by counting light nodes, each path's level. A light
child has at most half of its parent's members: there are at most log2(conversations) + 1 levels. From the deepest
level up, suffix sums along the paths give the sums of subtrees, and the sums at the heads are added to the nodes that
they hang on, in the level above.

Members that end at a node are written as sorted blocks, range by range, and hashed block after block, so that no list
of members is held. Joins to parents, of which one may have most nodes as children, go through join_counted().

Defined cases: rows with a null conv_id belong to no conversation and are left out; a null role or text counts as empty;
turns are ordered by turn (null first), equal ones by the MD5 of role and text, and rows that repeat are turns of their
own; a conversation is read as one sorted stream, whatever its length; an empty table has no nodes, not even the root.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainfold.llm.common import join_counted, partitions, ship_package, stash

#: Ids in one block of a node's sorted ends.
BLOCK = 1 << 16
NODE, PARENT = ["k1", "k2"], ["p1", "p2"]
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), content (MD5 of role and text), n_bytes (UTF-8, of the text)."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(
        conversations["conv_id"].cast("bigint").alias("conv_id"), conversations["turn"].alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("content"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "content")
    return turns.where("conv_id IS NOT NULL").select("conv_id", (F.row_number().over(order) - 1).alias("pos"), "content", "n_bytes")


def rebuilt_turns(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Each conversation c as the first h turns of conversation c - c % 5 and its own turns after its first h; h = crc32(c) % 9."""
    borrowed = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    own = turns.where(F.col("pos") >= borrowed).withColumn("part", F.lit(1))
    takers = F.filter(F.sequence(F.col("base") - 4, F.col("base") + 4), lambda c: c - c % 5 == F.col("base"))
    lent = turns.where("conv_id % 5 = 0 AND pos < 8").withColumnRenamed("conv_id", "base").withColumn("conv_id", F.explode(takers))
    lent = lent.where(F.col("pos") < borrowed).drop("base").join(ids, "conv_id", "left_semi").withColumn("part", F.lit(0))
    return own.unionByName(lent)


def prefixes(turns: DataFrame) -> DataFrame:
    """One row for each prefix of each conversation: conv_id, depth, its key and its parent's, n_bytes, is_end.

    turns: conv_id, content, n_bytes and, for their order, part and pos.
    """
    order = Window.partitionBy("conv_id").orderBy("part", "pos")
    rows = turns.withColumn("depth", F.row_number().over(order))
    rows = rows.withColumn("h1", F.xxhash64("depth", "content")).withColumn("h2", F.xxhash64("content", "depth"))
    return rows.select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), "n_bytes",
        F.bit_xor("h1").over(order).alias("k1"), F.bit_xor("h2").over(order).alias("k2"), "h1", "h2",
        F.lead("depth").over(order).isNull().alias("is_end"),
    ).select("conv_id", "depth", *NODE, F.expr("k1 ^ h1").alias("p1"), F.expr("k2 ^ h2").alias("p2"), "n_bytes", "is_end")


def ends(found: DataFrame, turnless: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 of the nodes at which conversations end."""
    root = turnless.select(F.lit(0).cast("bigint").alias("k1"), F.lit(0).cast("bigint").alias("k2"), "conv_id")
    rows = found.where("is_end").select(*NODE, "conv_id").unionByName(root)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of one node in sorted rows, cut into blocks; a run that a batch cuts is two blocks."""
        for batch in batches:
            k1, k2, ids = (batch[c].to_numpy() for c in ("k1", "k2", "conv_id"))
            new = np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
            starts = np.flatnonzero(new)
            starts = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)])
            text = [",".join(map(str, part)) for part in np.split(ids, starts[1:])]
            yield pa.RecordBatch.from_pydict({"k1": k1[starts], "k2": k2[starts], "least": ids[starts], "ids": pa.array(text, pa.string())})

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            out = []
            for k1, k2, ids in zip(*(batch[c].to_pylist() for c in ("k1", "k2", "ids")), strict=True):
                if (k1, k2) == now:
                    sha.update(b"," + ids.encode())
                else:
                    if sha:
                        out.append((*now, sha.hexdigest()))
                    now, sha = (k1, k2), hashlib.sha256(ids.encode())
            yield digests(out)
        if sha:
            yield digests([(*now, sha.hexdigest())])

    def digests(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["k1", "k2", "ends_sha256"])

    n = partitions(found.sparkSession)
    cut = rows.repartitionByRange(n, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(blocks, "k1 bigint, k2 bigint, least bigint, ids string")
    return cut.repartition(n, *NODE).sortWithinPartitions(*NODE, "least").mapInArrow(hashed, "k1 bigint, k2 bigint, ends_sha256 string")


def heavy_paths(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """The columns of nodes, one row each, with path (a conversation) and level (light nodes from the root on)."""
    leaves = nodes.where("n_children = 0 AND depth > 0").select("conv_id")
    rows = found.join(leaves.hint("merge"), "conv_id", "left_semi").select(F.col("conv_id").alias("path"), *NODE)
    rows = rows.unionByName(leaves.select(F.col("conv_id").alias("path"), F.lit(0).cast("bigint").alias("k1"), F.lit(0).cast("bigint").alias("k2")))
    sizes = rows.groupBy(*NODE).agg(F.count(F.lit(1)).alias("on_paths"))
    rows = join_counted(rows, stash(nodes.join(sizes.hint("merge"), NODE), "heavy"), NODE, "on_paths").drop("on_paths")
    up = Window.partitionBy("path").orderBy(F.desc("depth"))
    light = (~F.col("heavy") & (F.col("depth") > 0)).cast("int")
    cut = F.coalesce(F.max((~F.col("heavy")).cast("int")).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("level", F.sum(light).over(Window.partitionBy("path"))).withColumn("cut", cut).where("cut = 0").drop("cut")


def subtree_sums(paths: DataFrame) -> DataFrame:
    """paths with n_leaves and saved_tokens summed over each node's subtree, level by level."""
    carried, done = None, []
    deepest = paths.agg(F.max("level")).first()[0]
    for level in range(-1 if deepest is None else deepest, -1, -1):
        rows = paths.where(F.col("level") == level)
        leaves, saved = F.col("leaf"), F.col("saved")
        if carried is not None:
            rows = rows.join(carried.hint("merge"), NODE, "left")
            leaves, saved = leaves + F.coalesce("more_leaves", F.lit(0)), saved + F.coalesce("more_saved", F.lit(0))
        below = Window.partitionBy("path").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("n_leaves", F.sum(leaves).over(below)).withColumn("saved_tokens", F.sum(saved).over(below))
        rows = stash(rows.drop("more_leaves", "more_saved", "level", "path", "leaf", "saved"), "level")
        done.append(rows)
        heads = rows.where("NOT heavy").select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_leaves", "saved_tokens")
        carried = heads.groupBy(*NODE).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
    if not done:
        return paths.select("*", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens")).limit(0)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of the trie of turns (see prefixes()); ids: conv_id of all conversations, those without turns too."""
    found = stash(prefixes(turns), "prefixes")
    turnless = ids.join(found.select("conv_id").distinct(), "conv_id", "left_anti")
    nodes = found.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
        F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes"),
    )
    nothing = F.lit(None).cast("bigint")
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        F.lit(0).cast("bigint").alias("k1"), F.lit(0).cast("bigint").alias("k2"), "conv_id", F.lit(0).cast("bigint").alias("depth"),
        nothing.alias("p1"), nothing.alias("p2"), "n_convs", F.lit(0).cast("bigint").alias("n_bytes"),
    )
    nodes = stash(nodes.unionByName(root), "nodes")
    children = nodes.where("depth > 0").groupBy(*PARENT).agg(F.count(F.lit(1)).alias("n_children"), F.max(F.struct("n_convs", *NODE)).alias("largest"))
    own = nodes.join(children.withColumnsRenamed({"p1": "k1", "p2": "k2"}).hint("merge"), NODE, "left")
    own = stash(own.withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("bigint")), "families")
    parents = own.where("n_children > 0").select(
        F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("brood"),
        F.col("largest.k1").alias("l1"), F.col("largest.k2").alias("l2"),
    )
    own = own.drop("largest")
    below = join_counted(own.where("depth > 0"), parents, PARENT, "brood").withColumn("heavy", F.expr("k1 = l1 AND k2 = l2")).drop("brood", "l1", "l2")
    top = own.where("depth = 0").withColumn("parent_conv_id", nothing).withColumn("heavy", F.lit(False))
    whole = below.unionByName(top)
    whole = whole.withColumn("leaf", (F.col("n_children") == 0).cast("bigint")).withColumn("saved", (F.col("n_convs") - 1) * F.col("n_bytes"))
    whole = stash(whole, "whole")
    paths = heavy_paths(found, whole)
    alone = whole.where("depth = 0 AND n_children = 0").select(F.col("conv_id").alias("path"), "*", F.lit(0).cast("bigint").alias("level"))
    sums = subtree_sums(stash(paths.unionByName(alone), "paths", by=("level",)))
    return sums.join(ends(found, turnless).hint("merge"), NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are."""
    ship_package(conversations.sparkSession)
    turns = numbered_turns(conversations).withColumn("part", F.lit(0))
    return trie(turns, turns.select("conv_id").distinct())


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations that rebuilt_turns() makes of these."""
    ship_package(conversations.sparkSession)
    turns = stash(numbered_turns(conversations), "turns")
    ids = stash(turns.select("conv_id").distinct(), "ids")
    return trie(rebuilt_turns(turns, ids), ids)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: crc32 by eight steps a byte; keys of prefixes are their turns' hashes in a row.
ORACLE = r"""
WITH ids AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
), t AS (
  SELECT conv_id, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS content, strlen(coalesce(text, '')) AS n_bytes, turn
  FROM conversations WHERE conv_id IS NOT NULL
), numbered AS (
  SELECT conv_id, content, n_bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, content) - 1 AS pos FROM t
), rebuilt AS (
  SELECT i.conv_id, 0 AS part, n.pos, n.content, n.n_bytes FROM ids i JOIN numbered n ON n.conv_id = i.conv_id - i.conv_id % 5 AND n.pos < i.h
  UNION ALL SELECT i.conv_id, 1, n.pos, n.content, n.n_bytes FROM ids i JOIN numbered n ON n.conv_id = i.conv_id AND n.pos >= i.h
), found AS (
  SELECT conv_id, n_bytes, string_agg(content, '') OVER w AS node, row_number() OVER w AS depth, lead(part) OVER w IS NULL AS is_end
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
  UNION ALL SELECT conv_id, 0, '', 0, conv_id NOT IN (SELECT conv_id FROM rebuilt) FROM ids
), nodes AS (
  SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, max(n_bytes) AS n_bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
  FROM found GROUP BY node
), kin AS (SELECT *, CASE WHEN depth > 0 THEN left(node, -32) END AS parent FROM nodes),
kids AS (SELECT parent AS node, count(*) AS n_children FROM kin WHERE depth > 0 GROUP BY parent),
whole AS (SELECT k.*, coalesce(c.n_children, 0) AS n_children FROM kin k LEFT JOIN kids c USING (node)),
sums AS (
  SELECT f.node, sum((w.n_children = 0)::INT) AS n_leaves, sum((w.n_convs - 1) * w.n_bytes) AS saved
  FROM whole w JOIN found f ON f.conv_id = w.conv_id AND f.depth <= w.depth GROUP BY f.node
)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, w.ends_sha256
FROM whole w JOIN sums s USING (node) LEFT JOIN nodes p ON p.node = w.parent
"""
