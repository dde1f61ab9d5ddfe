"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of equal slots of ``block`` words.  Slot ``i`` gets the
golden-ratio point ``i * G mod 2^32``; cumulative target shares cut the
interval into one piece per source, so the point names the slot's source and
every stretch of the schedule is close to the target shares.  The slots of a
source are ranked; its documents, shuffled by a hash of their id, form a
stream that is cut into blocks of ``block`` words and read at most twice; the
slot of rank ``r`` takes block ``r``.

Everything is DataFrame expressions.  Positions and ranks are two-level
prefix sums (within a bounded bucket, then over buckets), so a source with a
third of all rows is never ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut, words_column

# floor(2^32 / golden ratio), the odd step of the point sequence. [fixed value]
GOLDEN = 2654435769
TURN = 1 << 32
COARSE_BITS = 20        # points are matched to sources by their top 12 bits first
CHUNK_BITS = 16         # slots ranked at a time
BUCKET_HEX = 3          # documents of a source ordered in 16^3 hash buckets
MAX_BROADCAST_SOURCES = 100_000
BLOCK = 32
SHARE = 1.5
MAX_PASSES = 2


def word_count(text):
    """Number of words (runs outside space and U+0009..U+000D); null: 0."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"[\x20\x09-\x0D]+"))).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = SHARE,
                   passes: int = MAX_PASSES) -> DataFrame:
    """``sizes(source, size)`` -> one row per source with its target.

    Sources by code point, null last, weigh ``weights`` repeating.  They
    share ``share`` of all words by weight; a target stops at ``passes``
    times its source's size and the excess goes to the others by weight
    until none is above.  That level is the largest of the levels left after
    filling sources in order of capacity per weight.  ``lo``/``hi`` are the
    source's part of ``[0, 2^32)``.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())   # one row per source
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = (per.withColumn("sid", F.row_number().over(order).cast("long") - 1)
              .withColumn("weight", F.element_at(w, (F.col("sid") % len(weights) + 1).cast("int")))
              .withColumn("cap", F.col("source_size") * float(passes)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(all_) * share - F.coalesce(F.sum("cap").over(fill), F.lit(0.0)))
             / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0))))
    target = (ranked.withColumn("level", level)
              .withColumn("target", F.least("cap", F.max("level").over(all_) * F.col("weight"))))
    up = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("target").over(all_)
    hi = F.when(total > 0, F.floor(F.sum("target").over(up) / total * float(TURN))).otherwise(0)
    cutted = target.withColumn("hi", F.least(hi.cast("long"), F.lit(TURN)))
    cutted = cutted.withColumn("hi", F.when(F.col("sid") == F.max("sid").over(all_), F.lit(TURN)).otherwise(F.col("hi")))
    lo = F.coalesce(F.lag("hi").over(Window.orderBy("sid")), F.lit(0))
    return cutted.withColumn("lo", lo.cast("long")).select(
        "source", "sid", "weight", "source_size", "target", "lo", "hi")


def point_of(slot: str):
    """``slot * GOLDEN mod 2^32`` in two halves of 16 bits, so that no slot
    number is too large for it."""
    low, high = f"({slot} & 65535)", f"(shiftright({slot}, 16) & 65535)"
    return F.expr(f"pmod(pmod({high} * {GOLDEN}L, 65536L) * 65536L + {low} * {GOLDEN}L, {TURN}L)")


def schedule(spark: SparkSession, targets: DataFrame, n_slots: int, n_sources: int) -> DataFrame:
    """``(slot, sid, rank)`` of every slot: golden-ratio points through the
    cumulative shares, slots ranked per source in schedule order."""
    slots = spark.range(1, n_slots + 1).select(F.col("id").alias("slot"), point_of("id").alias("point"))
    slots = slots.withColumn("coarse", F.shiftright("point", COARSE_BITS))
    pieces = (targets.where("hi > lo").select(
        "sid", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", COARSE_BITS),
                                                F.shiftright(F.col("hi") - 1, COARSE_BITS))).alias("coarse")))
    if n_sources <= MAX_BROADCAST_SOURCES:    # at most 4,096 + n_sources pieces
        pieces = F.broadcast(pieces)
    dealt = (slots.join(pieces, "coarse").where("point >= lo and point < hi")
             .select("sid", "slot", F.shiftright("slot", CHUNK_BITS).alias("chunk")))
    inside = dealt.withColumn("at", F.row_number().over(
        Window.partitionBy("sid", "chunk").orderBy("slot")).cast("long"))
    per_chunk = dealt.groupBy("sid", "chunk").count()
    before = per_chunk.select("sid", "chunk", F.coalesce(F.sum("count").over(
        Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("before"))
    return inside.join(before, ["sid", "chunk"]).select(
        "slot", "sid", (F.col("before") + F.col("at") - 1).alias("rank"))


def positions(sized: DataFrame, targets: DataFrame, n_sources: int) -> DataFrame:
    """Adds ``sid``, ``source_size``, ``target`` and ``start``, the first word
    of the document in its source's shuffled stream."""
    of = targets.select(F.col("source").alias("s"), "sid", "source_size", "target")
    if n_sources <= MAX_BROADCAST_SOURCES:
        of = F.broadcast(of)
    d = sized.join(of, sized.source.eqNullSafe(of.s)).drop("s")
    d = d.withColumn("mix", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    d = d.withColumn("bucket", F.substring("mix", 1, BUCKET_HEX))
    per = d.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    before = per.select("sid", "bucket", F.coalesce(F.sum("n").over(
        Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("before"))
    inside = Window.partitionBy("sid", "bucket").orderBy("mix", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, 0)
    d = d.withColumn("up", F.sum("size").over(inside))
    return (d.join(before, ["sid", "bucket"])
            .withColumn("start", F.col("before") + F.col("up") - F.col("size"))
            .drop("mix", "bucket", "before", "up"))


def taken_pieces(spark: SparkSession, docs: DataFrame, weights, share: float,
                 block: int) -> tuple[DataFrame, DataFrame]:
    """``(placed, pieces)``: the documents with their places, and ``(slot,
    sid, start, at, word, n)``: ``n`` words of the document at ``start``, from
    its word ``word`` on, stand in the slot from the slot's word ``at`` on."""
    sized = cut(spark, docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    targets = cut(spark, source_targets(sized, weights, share))
    n_sources, words = targets.agg(F.count("*"), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    placed = cut(spark, positions(sized, targets, n_sources))
    slots = schedule(spark, targets, -int(-words // block), n_sources)
    twice = placed.where("size > 0").select(
        "sid", "start", "size",
        F.explode(F.array(F.col("start"), F.col("start") + F.col("source_size"))).alias("x"))
    low = F.greatest(F.col("x"), F.col("rank") * block)
    pieces = (twice.select("sid", "start", "x", (F.col("x") + F.col("size")).alias("y"), F.explode(
        F.expr(f"sequence(x div {block}, (x + size - 1) div {block})")).alias("rank"))
        .select("sid", "start", "rank", (low - F.col("rank") * block).alias("at"), (low - F.col("x")).alias("word"),
                (F.least(F.col("y"), (F.col("rank") + 1) * block) - low).alias("n")))
    return placed, pieces.join(slots, ["sid", "rank"])


def mix(spark: SparkSession, docs: DataFrame, weights=(5, 2, 1), share: float = SHARE,
        block: int = BLOCK) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, source, start)`` per row.

    ``size``: words of the text (null: 0); ``taken``: words the mix takes
    from the document, repeats counted, at most twice its size.  Rows with a
    null id or source take part; repeated rows are documents of their own;
    documents without words are never taken; an empty table gives no rows;
    further columns are ignored.  Nothing is random: reruns agree.
    """
    placed, pieces = taken_pieces(spark, docs, weights, share, block)
    took = pieces.groupBy("sid", "start").agg(F.sum("n").alias("took")).withColumn("some", F.lit(True))
    keyed = placed.withColumn("some", F.col("size") > 0)
    return (keyed.join(took, ["sid", "start", "some"], "left")
            .select("doc_id", "size", "source_size", "target",
                    F.coalesce("took", F.lit(0)).cast("long").alias("taken"), "source", "start"))


def mixed_blocks(spark: SparkSession, docs: DataFrame, weights=(5, 2, 1), share: float = SHARE,
                 block: int = BLOCK) -> DataFrame:
    """``(slot, at, source, doc_id, start, word, n)``: the mix itself, in the
    order of ``slot`` (from 1) and ``at``: ``n`` words of the document from its
    word ``word`` on; ``start`` tells repeated rows of a source apart.  The
    last block of a source that is read to its end may be short or empty."""
    placed, pieces = taken_pieces(spark, docs, weights, share, block)
    of = placed.where("size > 0").select("sid", "start", "source", "doc_id")
    return pieces.join(of, ["sid", "start"]).select("slot", "at", "source", "doc_id", "start", "word", "n")


def mixed_documents(spark: SparkSession, docs: DataFrame, weights=(5, 2, 1),
                    share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """The mix as documents, all columns kept: a document comes once per pass
    that reaches it.  A pass that ends inside a document takes its first
    words, joined by one space; whole copies keep their text as it is.
    Copies of one document share its ``doc_id``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])      # whatever their names
    base = docs.select(row.alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("src"),
                       word_count(F.col("text")).alias("size"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("key"))
    # repeated rows (same id, source, text) are told apart by their number
    base = base.withColumn("n", F.row_number().over(Window.partitionBy("id", "src", "size").orderBy("key")))
    took = mix(spark, docs, weights, share, block).where("taken > 0")
    took = (took.withColumn("n2", F.row_number().over(
        Window.partitionBy("doc_id", "source", "size").orderBy("start")))
        .select(F.col("doc_id").alias("d2"), F.col("source").alias("s2"),
                F.col("size").alias("z2"), "n2", "taken"))
    both = base.join(took, F.col("id").eqNullSafe(F.col("d2")) & F.col("src").eqNullSafe(F.col("s2"))
                     & (F.col("size") == F.col("z2")) & (F.col("n") == F.col("n2")))
    passes = both.withColumn("take", F.explode(F.expr(
        "filter(array(least(taken, size), taken - size), x -> x > 0)")))
    cut_text = F.array_join(F.slice(words_column(F.col("row.text")), 1, F.col("take").cast("int")), " ")
    whole = F.col("take") == F.col("size")
    out = F.col("row").withField("text", F.when(whole, F.col("row.text")).otherwise(cut_text))
    if "n_chars" in docs.columns:
        out = out.withField("n_chars", F.when(whole, F.col("row.n_chars")).otherwise(
            F.char_length(cut_text)).cast(docs.schema["n_chars"].dataType))
    return passes.select(out.alias("row")).select("row.*")


def oracle(weights=(5, 2, 1), share: float = SHARE, block: int = BLOCK) -> str:
    """DuckDB SQL with the rows of ``mix`` (first five columns)."""
    wl = ", ".join(str(float(x)) for x in weights)
    return rf"""
WITH sized AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                                         lambda w: w <> ''))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1)::BIGINT AS sid FROM per),
weighed AS (
  SELECT *, ([{wl}])[(sid % {len(weights)} + 1)::INT]::DOUBLE AS weight,
         source_size * {float(MAX_PASSES)}::DOUBLE AS cap FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () * {share}::DOUBLE
             - coalesce(sum(cap) OVER f, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0.0)) AS level
  FROM weighed WINDOW f AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT *, least(cap, max(level) OVER () * weight) AS target FROM levels),
his AS (
  SELECT *, CASE WHEN sid = max(sid) OVER () THEN {TURN}
            WHEN sum(target) OVER () > 0
            THEN least(floor(sum(target) OVER (ORDER BY sid ROWS UNBOUNDED PRECEDING)
                             / sum(target) OVER () * {float(TURN)}::DOUBLE)::BIGINT, {TURN})
            ELSE 0 END AS hi FROM targets),
shares AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY sid), 0) AS lo FROM his),
points AS (
  SELECT i AS slot, (i::HUGEINT * {GOLDEN} % {TURN})::BIGINT AS point
  FROM range(1, (SELECT ceil(sum(target) / {block})::BIGINT + 1 FROM shares)) t(i)),
slots AS (
  SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank
  FROM points JOIN shares ON point >= lo AND point < hi),
placed AS (
  SELECT d.*, t.sid, t.source_size, t.target,
         (sum(size) OVER (PARTITION BY t.sid ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size
                          ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM sized d JOIN shares t ON d.source IS NOT DISTINCT FROM t.source),
passes AS (
  SELECT sid, start, size, unnest([start, start + source_size]) AS x FROM placed WHERE size > 0),
pieces AS (
  SELECT sid, start, x, size, unnest(range(x // {block}, (x + size - 1) // {block} + 1)) AS rank FROM passes),
took AS (
  SELECT sid, start, sum(least(x + size, (rank + 1) * {block}) - greatest(x, rank * {block}))::BIGINT AS took
  FROM pieces JOIN slots USING (sid, rank) GROUP BY sid, start)
SELECT doc_id, size, source_size, target, coalesce(took, 0)::BIGINT AS taken
FROM placed LEFT JOIN took ON took.sid = placed.sid AND took.start = placed.start AND placed.size > 0
"""
