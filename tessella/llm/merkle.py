"""Merkle dataset manifest by slot pivots.

A document's leaf is the SHA-256 of its fields; the leaves of a source, in
ascending ``doc_id``, form a tree of fanout 3, and the subroots of all sources,
in the order of the sources, form the tree above them.  A level is one
aggregation: conditional aggregates spread the children of each parent into
the columns ``c0 .. c2`` by their slot, and the hash of the columns in order
is the parent.  Proofs go down the same tables: a parent's row gives each of
its children the other columns, cut into those left and right of its own
slot, and what the parent got from above.  The tables of a tree hold half as
many rows as it has leaves, and a level is written before the next one starts,
so a lost executor costs the current level only.

Digests are binary inside and hexadecimal text wherever they are hashed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import written
from tessella.llm.ranks import ranked

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<l: binary, r: binary>>"


def digest(data):
    return F.unhex(F.sha2(data, 256))


def hexed(binary):
    return F.lower(F.hex(binary))


def hash_of(*digests):
    """Digest of digests, taken as hexadecimal text one after the other."""
    return digest(hexed(F.concat(*digests)))


def field(value):
    """``-`` for null, else its UTF-8 byte count, ``:`` and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_of(text=None):
    fields = [F.col(c) if c != "text" or text is None else text for c in FIELDS]
    return digest(F.concat(*[field(c) for c in fields]))


def tampered_text():
    """The text that a tampered copy holds: without its line feeds where the
    CRC-32 of the id is even.  A null id is not tampered with."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even & F.contains("text", F.lit("\n")), F.translate("text", "\n", ""))


def _height(n: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def _up(n):
    return F.floor((F.col(n) + (FANOUT - 1)) / FANOUT)


def tree(spark: SparkSession, nodes: DataFrame, name: str, carry: tuple[str, ...] = ()) -> tuple[list[DataFrame], DataFrame]:
    """Trees over ``nodes(g, idx, n, h, ..)``, one per group ``g``.

    Returns the tables of parents from the lowest level up, ``(g, idx, n, c0,
    c1, c2, h)`` with ``n`` the group's nodes on that level, and ``tops(g, h,
    height)``.  The lowest table holds the ``carry`` columns of the leaves as
    structs ``p0 .. p2`` besides.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, tops = [], nodes.where("n = 1").select("g", "h", F.lit(0).alias("height"))
    for k in range(1, _height(most) + 1):
        slot = F.pmod("idx", F.lit(FANOUT))
        spread = [F.max(F.when(slot == s, F.col("h"))).alias(f"c{s}") for s in range(FANOUT)]
        if k == 1 and carry:
            spread += [F.max(F.when(slot == s, F.struct(*carry))).alias(f"p{s}") for s in range(FANOUT)]
        parents = (nodes.where("n > 1").groupBy("g", F.floor(F.col("idx") / FANOUT).alias("at"), _up("n").alias("n"))
                   .agg(*spread).withColumnRenamed("at", "idx")
                   .withColumn("h", hash_of(*[F.coalesce(f"c{s}", F.lit(b"")) for s in range(FANOUT)])))
        levels.append(written(spark, parents, f"{name}-{k}"))
        nodes = levels[-1].select("g", "idx", "n", "h")
        tops = tops.unionAll(nodes.where("n = 1").select("g", "h", F.lit(k).alias("height")))
    return levels, tops


def proofs(levels: list[DataFrame], tops: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """From ``tops(g, h, height, steps, kept ..)`` down to the leaves:
    ``(g, idx, h, [p,] steps, kept ..)``, where ``steps`` holds what stands
    left and right of the node on each level, its own first.  Leaves that are
    tops themselves are not among them."""
    down = None
    for k in reversed(range(1, len(levels) + 1)):
        here = tops.where(F.col("height") == k).select("g", F.lit(0).cast("long").alias("idx"), "steps", *kept)
        here = here if down is None else here.unionByName(down)
        table = levels[k - 1]
        payload = "p0" in table.columns
        c = [F.coalesce(f"c{s}", F.lit(b"")) for s in range(FANOUT)]
        children = F.array(*[F.when(F.col(f"c{s}").isNotNull(), F.struct(
            F.lit(s).alias("slot"), F.col(f"c{s}").alias("h"),
            F.concat(*c[:s], F.lit(b"")).alias("l"), F.concat(*c[s + 1:], F.lit(b"")).alias("r"),
            *([F.col(f"p{s}").alias("p")] if payload else []))) for s in range(FANOUT)])
        down = (table.drop("h").join(here, ["g", "idx"])
                .select("g", "idx", "steps", *kept, F.explode(F.filter(children, lambda x: x.isNotNull())).alias("x"))
                .select("g", (F.col("idx") * FANOUT + F.col("x.slot")).alias("idx"), "x.h",
                        *(["x.p"] if payload else []),
                        F.concat(F.array(F.struct("x.l", "x.r")), "steps").alias("steps"), *kept))
        if k > 1:
            down = down.drop("h")
    return down


def folded(leaf, steps):
    """The root that a leaf and the steps of a proof lead to."""
    return F.aggregate(steps, leaf, lambda h, x: hash_of(x["l"], h, x["r"]))


def manifest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``(doc_id, source, leaf, other_leaf, subroot, root, steps)``, one row
    per document: the digests (binary) of its row and of its tampered copy,
    and its proof, the ``(l, r)`` siblings of every level from the leaf up.

    Null fields hash as ``-`` (empty ones as ``0:``); null ids come first and
    null sources are a source of their own that comes first; repeated ids
    stand in the order of their leaves, repeated rows are equal leaves; the
    only document of the only source is its own root; an empty table gives no
    rows; columns beside the five of ``documents`` are ignored.
    """
    # what is kept of a document is narrow: texts are read once
    other = F.when(tampered_text().isNotNull(), leaf_of(tampered_text()))
    rows = written(spark, docs.select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("g"),      # null first, bytewise
        "doc_id", leaf_of().alias("h"), other.alias("other"),
        F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    leaves = ranked(spark, rows, "g", ["doc_id", "h", "row"], "merkle-ordered").select(
        "g", "idx", "n", "h", "doc_id", "other")
    low, subroots = tree(spark, leaves, "merkle-source", carry=("doc_id", "other"))
    subroots = written(spark, subroots, "merkle-subroots")
    order = ranked(spark, subroots.select(F.lit(0).alias("all"), "g", "h", "height"), "all", ["g"], "merkle-sources")
    order = written(spark, order, "merkle-numbered")
    high, root = tree(spark, order.select(F.col("all").alias("g"), "idx", "n", "h"), "merkle-top")
    root = root.select("g", "h", "height", F.expr(f"cast(array() as {STEPS})").alias("steps"), F.col("h").alias("root"))
    # the proof of every subroot; one source has nothing above it
    if high:
        above = proofs(high, root, ("root",)).select("idx", "steps", "root")
    else:
        above = root.select(F.lit(0).cast("long").alias("idx"), "steps", "root")
    tops = written(spark, order.join(above, "idx").select("g", "h", "height", "steps", "root", F.col("h").alias("subroot")),
                   "merkle-tops")
    single = (leaves.where("n = 1").drop("h", "idx", "n").join(tops, "g")
              .select("g", "doc_id", "other", F.col("subroot").alias("h"), "steps", "subroot", "root"))
    out = single
    if low:
        deep = proofs(low, tops, ("subroot", "root"))
        out = out.unionByName(deep.select("g", "p.doc_id", "p.other", "h", "steps", "subroot", "root"))
    return out.select("doc_id", F.expr("if(g = '', null, substr(g, 2))").alias("source"), F.col("h").alias("leaf"),
                      F.coalesce("other", "h").alias("other_leaf"), "subroot", "root", "steps")


def verified(entries: DataFrame) -> DataFrame:
    """The manifest in text form, each document's tampered (or else its own)
    leaf folded with its proof and compared with the root."""
    siblings = F.aggregate("steps", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["l"], x["r"]))
    return (entries.withColumn("up", folded(F.col("other_leaf"), F.col("steps")))
            .select("doc_id", hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"),
                    hexed(F.col("root")).alias("root"), F.sha2(hexed(siblings), 256).alias("proof_sha256"),
                    hexed(F.col("up")).alias("folded_root"), (F.col("up") == F.col("root")).alias("verified")))


def oracle(depth: int = 20) -> str:
    """DuckDB SQL with the rows of ``verified(manifest(documents))``: plain
    levels over row numbers, up to ``3 ** depth`` nodes of a tree."""
    def f(c):
        return f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"

    def leaf(text):
        return "sha256(" + " || ".join(f(text if c == "text" else c) for c in FIELDS) + ")"

    crc = ("xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), "
           "lambda c: ascii(c)::BIGINT)), lambda crc, b: list_reduce(list_concat([xor(crc, b)], "
           "[0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)")

    def up(name, src):
        return f"""{name}(lvl, g, idx, n, h) AS (
    SELECT 0, g, idx, n, h FROM {src}
    UNION ALL
    SELECT lvl + 1, g, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx))
    FROM {name} WHERE n > 1 AND lvl < {depth} GROUP BY lvl, g, idx // 3, n)"""

    def walk(name, tree_, first, src):
        """Per start node: the siblings, and the tampered hash, level by level."""
        return f"""{name}(id, lvl, g, idx, sib, fold) AS (
    SELECT id, 0, g, idx, sib, fold FROM {src}
    UNION ALL
    SELECT w.id, w.lvl + 1, w.g, w.idx // 3,
           w.sib || coalesce(x.lo, '') || coalesce(x.hi, ''), sha256(coalesce(x.lo, '') || w.fold || coalesce(x.hi, ''))
    FROM {name} w JOIN (
        SELECT a.lvl, a.g, a.idx, string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx) AS lo,
               string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx) AS hi
        FROM {tree_} a JOIN {tree_} b ON a.lvl = b.lvl AND a.g = b.g AND a.idx // 3 = b.idx // 3
        WHERE a.n > 1 GROUP BY a.lvl, a.g, a.idx) x ON x.lvl = w.lvl AND x.g = w.g AND x.idx = w.idx)"""

    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('s' || source, '') AS g, {leaf('text')} AS h,
         CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS other
  FROM documents),
lf AS (SELECT row_number() OVER () AS id, doc_id, g, h, other,
              row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS idx,
              count(*) OVER (PARTITION BY g) AS n FROM d),
{up('low', 'lf')},
sub AS (SELECT 0 AS g, g AS s, h, row_number() OVER (ORDER BY encode(g)) - 1 AS idx, count(*) OVER () AS n
        FROM low WHERE n = 1),
{up('high', 'sub')},
w0 AS (SELECT id, g, idx, '' AS sib, other AS fold FROM lf),
{walk('wa', 'low', 0, 'w0')},
w1 AS (SELECT wa.id, 0 AS g, sub.idx, wa.sib, wa.fold FROM (
         SELECT * FROM wa QUALIFY row_number() OVER (PARTITION BY id ORDER BY lvl DESC) = 1) wa JOIN sub ON sub.s = wa.g),
{walk('wb', 'high', 0, 'w1')},
fin AS (SELECT * FROM wb QUALIFY row_number() OVER (PARTITION BY id ORDER BY lvl DESC) = 1)
SELECT lf.doc_id, lf.h AS leaf, sub.h AS subroot, top.h AS root, sha256(fin.sib) AS proof_sha256,
       fin.fold AS folded_root, fin.fold = top.h AS verified
FROM lf JOIN fin USING (id) JOIN sub ON sub.s = lf.g JOIN (SELECT h FROM high WHERE n = 1) top ON true
"""
