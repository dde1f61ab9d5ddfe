"""Conversation prefix trie by ROLLUP over positional turn-id columns.

A turn's id is the MD5 of its role and text with the text's length in bytes
behind it.  A conversation becomes rows of ``width`` columns ``t1 .. tW``, one
per block of that many turns, keyed by the node that the blocks before it lead
to.  One ROLLUP over the columns aggregates every prefix of all conversations
and all blocks together; ``grouping_id`` tells a row's depth, and rows whose
deepest column is null (a conversation that ended before) are no nodes.

The key of a block sums a hash of ``(position, turn id)`` over the turns
before it (four sums of 32-bit parts), so all blocks are keyed at once by
two-level running sums and no loop goes over the depth.  The smallest member
and the depth name a node.  A node belongs to its smallest member, so the
nodes of a conversation form the end of its path, and what a subtree sums is

    sum of what its members' nodes hold
    - what its smallest member's nodes hold + what those from its depth on hold

which a second ROLLUP over the conversations that own nodes gives.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import written
from tessella.llm.ranks import ranked, running

WIDTH = 8           # turns of a block: columns of the ROLLUP
LIMBS = ("k0", "k1", "k2", "k3")
ENDS = 512          # conversation ids of a stretch whose list is made at once
HEADS = 9           # rebuilt conversations take fewer than so many turns of another
FAMILY = 5


def turn_id(role: Column, text: Column) -> Column:
    """20 bytes: MD5 of role and text, then the text's UTF-8 length."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.unhex(F.md5(whole.cast("binary"))), F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 8, "0")))


def turn_bytes(tid: Column) -> Column:
    return F.conv(F.hex(F.substring(tid, 17, 4)), 16, 10).cast("long")


def ordered_turns(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """``(conv_id, idx, n, tid)``: turns ascending, null first, equal ones by
    their id; null roles and texts are empty, rows without a conversation
    have no place in one."""
    none = F.lit("")
    rows = conversations.where("conv_id is not null").select(
        "conv_id", "turn", turn_id(F.coalesce("role", none), F.coalesce("text", none)).alias("tid"),
        F.monotonically_increasing_id().alias("row"))
    rows = written(spark, rows, "trie-turns")
    return ranked(spark, rows, "conv_id", ["turn", "tid", "row"], "trie-ordered").select("conv_id", "idx", "n", "tid")


def rebuilt(turns: DataFrame, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Conversations that share their heads: the first ``h`` turns of the
    first conversation of each family of five, then the own ones after the
    first ``h``; ``h`` is the CRC-32 of the id modulo 9.

    ``turns(conv_id, idx, n, tid)`` -> ``(conv_id, pos, length, tid)`` with
    ``pos`` from 1, and the ids ``conv_id`` left without turns.
    """
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))
    heads = (turns.where((F.pmod("conv_id", F.lit(FAMILY)) == 0) & (F.col("idx") < HEADS - 1))
             .groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("idx", "tid"))).alias("head")))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    none = F.expr("cast(array() as array<struct<idx: bigint, tid: binary>>)")
    each = (turns.where("idx = 0").select("conv_id", "n", base.alias("base"), h.alias("h"))
            .join(heads, "base", "left")
            .withColumn("head", F.slice(F.coalesce("head", none), F.lit(1), F.col("h")))
            .withColumn("taken", F.size("head").cast("long"))
            .withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    first = each.select("conv_id", "length", F.explode("head").alias("x")).select(
        "conv_id", (F.col("x.idx") + 1).alias("pos"), "length", "x.tid")
    own = (turns.drop("n").join(each.select("conv_id", "h", "taken", "length"), "conv_id")
           .where(F.col("idx") >= F.col("h"))
           .select("conv_id", (F.col("idx") - F.col("h") + F.col("taken") + 1).alias("pos"), "length", "tid"))
    return first.unionByName(own), each.where("length = 0").select("conv_id")


def _node(block, keys, tids) -> Column:
    """Name of the node that a block's key and some of its columns lead to."""
    head = F.concat_ws(",", block.cast("string"), *[k.cast("string") for k in keys]).cast("binary")
    return F.unhex(F.md5(F.concat(head, *[F.coalesce(t, F.lit(b"")) for t in tids])))


def blocks(spark: SparkSession, turns: DataFrame, turnless: DataFrame, width: int) -> DataFrame:
    """``(conv_id, b, length, k0 .. k3, s0 .. s3, t1 .. tW)``, one row per
    conversation and block of ``width`` turns, one for a turnless one."""
    sums = [f"s{i}" for i in range(len(LIMBS))]
    mark = F.md5(F.concat(F.col("pos").cast("string").cast("binary"), F.lit(b":"), F.col("tid")))
    parts = turns.select("*", mark.alias("mark")).select(
        "conv_id", "pos", "length", "tid",
        *[F.conv(F.substring("mark", 8 * i + 1, 8), 16, 10).cast("long").alias(s) for i, s in enumerate(sums)])
    slot = F.pmod(F.col("pos") - 1, F.lit(width))
    wide = (parts.groupBy("conv_id", F.floor((F.col("pos") - 1) / width).alias("b"))
            .agg(F.max("length").alias("length"), *[F.sum(s).alias(s) for s in sums],
                 *[F.max(F.when(slot == j, F.col("tid"))).alias(f"t{j + 1}") for j in range(width)]))
    keyed = running(wide, "conv_id", "b", sums)
    keyed = keyed.withColumnsRenamed({f"before_{s}": k for s, k in zip(sums, LIMBS)})
    zero = F.lit(0).cast("long")
    empty = turnless.select("conv_id", *[
        (F.lit(None).cast("binary") if c.startswith("t") else zero).alias(c) for c in keyed.columns if c != "conv_id"])
    return written(spark, keyed.unionByName(empty), "trie-blocks")


def rollup(spark: SparkSession, rows: DataFrame, width: int, aggregates: str) -> DataFrame:
    """One row per prefix: ``b``, the key, the columns up to level ``j`` and
    ``aggregates``; ``depth`` counts the turns of the prefix."""
    tids = ", ".join(f"t{j}" for j in range(1, width + 1))
    keys = ", ".join(LIMBS)
    return spark.sql(f"""
        select *, b * {width} + j as depth from (
            select b, {keys}, {tids}, {width} - bit_count(grouping_id()) as j, {aggregates}
            from {{rows}} group by b, {keys}, rollup({tids}))
        where if(j = 0, b = 0, element_at(array({tids}), greatest(j, 1)) is not null)""", rows=rows)


def _sha_of_lists(batches):
    """SHA-256 of every node's list, whose stretches come in order, node by
    node; a list is hashed piece by piece and never held."""
    node, state = None, None
    for batch in batches:
        done = []
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name == node:
                state.update(b",")
            else:
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = name, hashlib.sha256()
            state.update(ids.encode())
        yield pa.record_batch([pa.array([d[0] for d in done], pa.binary()),
                               pa.array([d[1] for d in done], pa.string())], ["id", "ends_sha256"])
    if node is not None:
        yield pa.record_batch([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())],
                              ["id", "ends_sha256"])


def ends(table: DataFrame, width: int) -> DataFrame:
    """``(id, ends_sha256)`` of every node where conversations end: the hash
    of their ids, ascending, comma-joined.  Ids are joined into stretches
    first (an id is there once, so a stretch holds ``ENDS`` at most): a node
    where a third of all conversations end sends one row per stretch."""
    last = table.where(F.col("b") == F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / width))
    full = F.col("length") == (F.col("b") + 1) * width
    k = [F.col(c) for c in LIMBS]
    beyond = [F.col(c) + F.col(f"s{i}") for i, c in enumerate(LIMBS)]
    here = F.when(full, _node(F.col("b") + 1, beyond, [])).otherwise(
        _node(F.col("b"), k, [F.col(f"t{j}") for j in range(1, width)]))
    stretches = (last.select(here.alias("id"), "conv_id", F.floor(F.col("conv_id") / ENDS).alias("at"))
                 .groupBy("id", "at").agg(F.array_join(F.transform(
                     F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")))
    return (stretches.repartition("id").sortWithinPartitions("id", "at").select("id", "ids")
            .mapInArrow(_sha_of_lists, "id binary, ends_sha256 string"))


def trie(spark: SparkSession, turns: DataFrame, turnless: DataFrame, width: int = WIDTH) -> DataFrame:
    """The prefix trie of ``turns(conv_id, pos, length, tid)`` and the
    conversations ``turnless(conv_id)``: one row per node, ``(conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, tid)``.  No conversations give no rows."""
    table = blocks(spark, turns, turnless, width)
    sums = ", ".join(f"max(s{i}) as s{i}" for i in range(len(LIMBS)))
    found = rollup(spark, table, width, f"min(conv_id) as conv_id, count(*) as n_convs, max(length) as longest, {sums}")
    tids = [F.col(f"t{j}") for j in range(1, width + 1)]
    k = [F.col(c) for c in LIMBS]
    level = F.col("j")
    # a full block's node goes by the name of the next block's key; columns
    # above the level are null and count as nothing
    own = F.when(level == width, _node(F.col("b") + 1, [F.col(c) + F.col(f"s{i}") for i, c in enumerate(LIMBS)], [])
                 ).otherwise(_node(F.col("b"), k, tids[:-1]))
    above = _node(F.col("b"), k, [F.when(level > j, t) for j, t in enumerate(tids, 1) if j < width])
    last = F.get(F.array(*tids), level - 1)
    nodes = written(spark, found.select(
        "conv_id", "depth", "n_convs", last.alias("tid"), own.alias("id"),
        F.when(level > 0, above).alias("parent_id"),
        (F.col("longest") == F.col("depth")).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.coalesce(turn_bytes(last), F.lit(0))).alias("saved")), "trie-nodes")

    # what a conversation's own nodes hold, whole and from each depth on
    held = ["leaf", "saved"]
    inside = running(nodes.select("conv_id", "depth", *held), "conv_id", "depth", held, descending=True)
    own_sums = nodes.groupBy("conv_id").agg(*[F.sum(c).alias(f"all_{c}") for c in held])
    totals = rollup(spark, table.join(own_sums, "conv_id"), width, "min(conv_id) as conv_id, " + ", ".join(
        f"sum(all_{c}) as total_{c}, min_by(all_{c}, conv_id) as mine_{c}" for c in held))
    totals = totals.select("conv_id", "depth", *[(F.col(f"total_{c}") - F.col(f"mine_{c}")).alias(f"others_{c}") for c in held])
    parents = nodes.groupBy("parent_id").agg(F.count("*").alias("n_children")).where("parent_id is not null")
    named = nodes.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"))
    out = (inside.join(totals, ["conv_id", "depth"])
           .select("conv_id", "depth", *[(F.col(f"others_{c}") + F.col(c) + F.col(f"before_{c}")).alias(f"sum_{c}") for c in held])
           .join(nodes, ["conv_id", "depth"])
           .join(named, "parent_id", "left")
           .join(parents.withColumnRenamed("parent_id", "id"), "id", "left")
           .join(ends(table, width), "id", "left"))
    return out.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.col("sum_leaf").alias("n_leaves"), F.col("sum_saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"), "tid")


def oracle() -> str:
    """DuckDB SQL with the rows of the trie of rebuilt ``conversations``: all
    prefixes as strings, subtrees as distinct pairs of prefixes."""
    crc = ("xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), "
           "lambda c: ascii(c)::BIGINT)), lambda crc, b: list_reduce(list_concat([xor(crc, b)], "
           "[0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)")
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS x,
                  md5(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS m
           FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, m, octet_length(encode(x))::BIGINT AS bytes,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) - 1 AS idx FROM t),
c AS (SELECT conv_id, {crc} % {HEADS} AS h, conv_id - ((conv_id % {FAMILY}) + {FAMILY}) % {FAMILY} AS base
      FROM (SELECT DISTINCT conv_id FROM t)),
cn AS (SELECT c.*, least(h, (SELECT count(*) FROM o WHERE o.conv_id = c.base)) AS taken FROM c),
r AS (SELECT cn.conv_id, idx + 1 AS pos, m, bytes FROM cn JOIN o ON o.conv_id = base WHERE idx < h
      UNION ALL
      SELECT cn.conv_id, idx - h + taken + 1, m, bytes FROM cn JOIN o ON o.conv_id = cn.conv_id WHERE idx >= h),
p AS (SELECT conv_id, pos AS d, string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY pos) AS path, bytes FROM r
      UNION ALL SELECT conv_id, 0, '', 0 FROM c),
l AS (SELECT conv_id, max(d) AS len FROM p GROUP BY conv_id),
v AS (SELECT path, any_value(d) AS depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
             coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (len = d), '') AS ends
      FROM p JOIN l USING (conv_id) GROUP BY path),
kids AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY 1),
below AS (SELECT DISTINCT a.path AS path, b.path AS sub FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.d >= a.d),
sums AS (SELECT below.path, count(*) FILTER (kids.path IS NULL) AS n_leaves, sum((s.n_convs - 1) * s.bytes) AS saved
         FROM below JOIN v s ON s.path = below.sub LEFT JOIN kids ON kids.path = below.sub GROUP BY below.path)
SELECT v.conv_id, v.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(n_children, 0) AS n_children,
       n_leaves, saved::BIGINT AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN sums USING (path) LEFT JOIN kids ON kids.path = v.path
     LEFT JOIN v u ON v.depth > 0 AND u.path = left(v.path, length(v.path) - 32)
"""
