"""Quotation linking for chat formatting.

A message's lines are parsed into runs of equal quote level (the number of
leading ``>`` marks); runs of level 0 are its own words, the others quoted
passages.  Passages and own words are normalised (lower case, white space as
one space) and cut into units: the whole, its paragraphs, their lines and
their sentences.  The hashes of a passage's units are joined to those of
messages; each unit proposes the latest earlier message of the conversation
that has it and the first message of the corpus in a conversation before.  A
proposed message is the original if its words hold the whole passage as one
piece, so a quote of some paragraphs, lines or sentences, wrapped anew or not,
finds its message and one that only shares a unit does not.

A message replies to the original of its first linked passage of the lowest
level, without one to the message before it.  These replies make trees, the
threads: a message that quotes another conversation hangs below that one, with
all replies to it.  Conversations come without quotes in reply order: every
message is followed by the replies to it, each with the replies to that, in
the order of their turns.  The order
needs no walk through a tree: where a message's first reply is the next one of
its conversation they form a segment, all of a segment's messages come before
what hangs below them, and a segment's place is the path of segments above it,
put together by doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut, written
from tessella.llm.ranks import ranked, running

MARKS = r"^(?:[ \t]*>)+"
NO_CONVERSATION = -(1 << 63)      # stands for a null conversation id
DIGITS = 10                       # of a message's place in its segment


def norm(text):
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def hash_of(text):
    return F.unhex(F.md5(norm(text).cast("binary")))


def runs_of(text):
    """Array of ``(depth, body)``: lines joined while their level stays."""
    parsed = F.transform(F.split(text, "\r?\n"), lambda line: F.struct(
        F.char_length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", "")).alias("depth"),
        F.regexp_replace(line, MARKS + " ?", "").alias("body")))
    return F.aggregate(
        parsed, F.expr("cast(array() as array<struct<depth: int, body: string>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["depth"] == x["depth"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                x["depth"].alias("depth"),
                F.concat_ws("\n", F.get(acc, F.size(acc) - 1)["body"], x["body"]).alias("body")))))
        .otherwise(F.concat(acc, F.array(x))))


def units_of(text: Column) -> Column:
    """Distinct hashes of the normalised whole, paragraphs, lines and
    sentences of a text, blank ones left out."""
    paragraphs = F.split(text, r"\n[ \t]*(?:\r?\n[ \t]*)+")
    lines = F.split(text, r"\r?\n")
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(norm(p), r"(?<=[.!?]) ")))
    every = F.concat(F.array(text), paragraphs, lines, sentences)
    return F.array_distinct(F.transform(F.filter(every, lambda u: norm(u) != ""), hash_of))


def parsed_messages(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, c, key, own, quotes)``: own words and the quoted
    passages ``(depth, body)`` in order; ``key`` orders repeated turns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    has = text.rlike(r"(?m)^[ \t]*>")
    plain = F.expr("cast(array() as array<struct<depth: int, body: string>>)")
    m = messages.select("conv_id", "turn", "role", text.alias("t"), F.when(has, runs_of(text)).otherwise(plain).alias("runs"))
    kept = F.transform("runs", lambda r, i: F.when(
        (r["depth"] == 0) & (i + 1 < F.size("runs")),
        F.regexp_replace(r["body"], r"(?:^|\n)[^>\n]*\b[Ww]rote:[ \t]*\n?\s*$", "")).when(r["depth"] == 0, r["body"]))
    own = F.when(F.size("runs") == 0, F.col("t")).otherwise(
        F.btrim(F.array_join(F.filter(kept, lambda b: b.isNotNull() & (norm(b) != "")), "\n"), F.lit(" \t\r\n")))
    quotes = F.filter("runs", lambda r: (r["depth"] > 0) & (norm(r["body"]) != ""))
    return m.select("conv_id", "turn", "role", F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_CONVERSATION)).alias("c"),
                    F.xxhash64("role", "t").alias("key"), own.alias("own"), quotes.alias("quotes"),
                    F.monotonically_increasing_id().alias("row"))


def originals(spark, parsed: DataFrame, at: DataFrame) -> DataFrame:
    """``(c, idx, number, depth, c2, idx2)``: every quoted passage (``number``
    in its message) with the message it is taken from, of the proposed ones
    the latest of its own conversation or else the first of all."""
    # units are made once; several joins read them
    owned = written(spark, parsed.where(norm(F.col("own")) != "").select("row", F.explode(units_of(F.col("own"))).alias("hash"))
                    .join(at, "row").select("c", "idx", "hash"), "quotes-owned")
    passages = (parsed.where(F.size("quotes") > 0).select("row", F.posexplode("quotes").alias("number", "q"))
                .select("row", "number", "q.depth", "q.body"))
    asked = written(spark, passages.select("row", "number", "depth", F.explode(units_of(F.col("body"))).alias("hash"))
                    .join(at, "row").select("row", "c", "idx", "number", "depth", "hash"), "quotes-asked")
    # the latest earlier message of the conversation, without forming pairs
    null = F.lit(None)
    events = asked.select("*", null.cast("long").alias("has")).unionByName(owned.select(
        null.cast("long").alias("row"), "c", "idx", null.cast("int").alias("number"), null.cast("int").alias("depth"),
        "hash", F.col("idx").alias("has")))
    earlier = Window.partitionBy("c", "hash").orderBy("idx").rangeBetween(Window.unboundedPreceding, -1)
    inside = events.withColumn("idx2", F.max("has").over(earlier)).where("number is not null and idx2 is not null").select(
        "row", "c", "idx", "number", "depth", F.col("c").alias("c2"), "idx2")
    firsts = owned.groupBy("hash").agg(F.min(F.struct("c", "idx")).alias("o"))
    before = (asked.join(firsts, "hash").where(F.col("o.c") < F.col("c"))
              .select("row", "c", "idx", "number", "depth", F.col("o.c").alias("c2"), F.col("o.idx").alias("idx2")))
    proposed = inside.unionByName(before).distinct()
    # verified by the words of both; only texts of proposed messages move
    bodies = passages.select("row", "number", norm(F.col("body")).alias("body"))
    texts = at.select(F.col("row").alias("row2"), F.col("c").alias("c2"), F.col("idx").alias("idx2")).join(
        parsed.select(F.col("row").alias("row2"), "own"), "row2").select("c2", "idx2", "own")
    found = (proposed.join(bodies, ["row", "number"]).join(texts, ["c2", "idx2"])
             .where(F.contains(norm(F.col("own")), F.col("body"))))
    nearest = found.groupBy("c", "idx", "number", "depth", "c2").agg(
        F.max("idx2").alias("last"), F.min("idx2").alias("first"))
    own = F.col("c2") == F.col("c")
    # own conversation first, else the smallest conversation
    best = F.min(F.struct(F.when(own, 0).otherwise(1).alias("far"), "c2",
                          F.when(own, F.col("last")).otherwise(F.col("first")).alias("idx2")))
    return nearest.groupBy("c", "idx", "number", "depth").agg(best.alias("b")).select(
        "c", "idx", "number", "depth", "b.c2", "b.idx2")


def _sortable(x: Column) -> Column:
    """16 digits in the order of a long."""
    return F.lpad(F.hex(x.bitwiseXOR(F.lit(NO_CONVERSATION))), 16, "0")


def reply_order(spark, nodes: DataFrame) -> DataFrame:
    """``(c, idx, thread, path)`` from ``nodes(c, idx, pc, pidx)``, messages
    and what they reply to (null: nothing), which comes before them:
    ``path`` sorts the messages of a ``thread`` (the conversation of its
    root) in reply order."""
    first = (nodes.where("pc is not null").groupBy("pc", "pidx").agg(F.min(F.struct("c", "idx")).alias("f"))
             .select(F.col("pc").alias("c"), F.col("f.c").alias("fc"), F.col("f.idx").alias("fidx"), F.col("pidx").alias("idx")))
    # a message goes on with its segment if it is the first reply to the one before
    goes_on = first.where("fc = c and fidx = idx + 1").select("c", F.col("fidx").alias("idx"), F.lit(0).cast("long").alias("head"))
    flagged = nodes.join(goes_on, ["c", "idx"], "left").withColumn("head", F.coalesce("head", F.lit(1).cast("long")))
    placed = running(flagged, "c", "idx", ["head"]).withColumn("seg", F.col("before_head") + F.col("head"))
    starts = placed.where("head = 1").select("c", "seg", F.col("idx").alias("start"), "pc", "pidx")
    placed = cut(spark, placed.join(starts.select("c", "seg", "start"), ["c", "seg"])
                 .select("c", "idx", "seg", (F.col("idx") - F.col("start")).alias("at")))
    above = placed.select(F.col("c").alias("pc"), F.col("idx").alias("pidx"), F.col("seg").alias("pseg"), F.col("at").alias("pat"))
    # later messages of the segment above first, then in order of the replies
    place = F.concat(F.lit("1"), F.lpad((F.lit(10 ** DIGITS - 1) - F.col("pat")).cast("string"), DIGITS, "0"),
                     _sortable(F.col("c")), _sortable(F.col("start")))
    paths = starts.join(above, ["pc", "pidx"], "left").select(
        "c", "seg", F.when(F.col("pseg").isNotNull(), F.col("pc")).alias("ac"), F.col("pseg").alias("aseg"),
        F.when(F.col("pseg").isNotNull(), place).otherwise("").alias("path"), F.col("c").alias("thread"))
    paths = cut(spark, paths)
    while not paths.where("ac is not null").isEmpty():
        up = paths.select(F.col("c").alias("ac"), F.col("seg").alias("aseg"), F.col("ac").alias("nc"),
                          F.col("aseg").alias("nseg"), F.col("path").alias("before"), F.col("thread").alias("root"))
        paths = cut(spark, paths.join(up, ["ac", "aseg"], "left").select(
            "c", "seg", F.col("nc").alias("ac"), F.col("nseg").alias("aseg"),
            F.concat(F.coalesce("before", F.lit("")), "path").alias("path"), F.coalesce("root", "thread").alias("thread")))
    own = F.concat("path", F.lit("0"), F.lpad(F.col("at").cast("string"), DIGITS, "0"))
    return placed.join(paths.select("c", "seg", "path", "thread"), ["c", "seg"]).select("c", "idx", "thread", own.alias("path"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, position, text, parent_conv, parent_turn,
    link, n_quotes, n_linked, max_depth, thread, place)``, one row per message.

    ``link`` is ``quote``, ``previous`` or ``none`` (first of its
    conversation, nothing linked); ``place`` counts a thread's messages from
    0 in reply order, ``thread`` is the conversation it starts in;
    ``position`` counts a conversation's messages in the same order, thread by
    thread; ``text`` is without quotes.  Null texts count as empty; a
    null conversation id is a conversation of its own kind; null turns come
    first; of repeated turns the order follows a hash, repeated rows are
    messages of their own; a passage that no message has stays unlinked; an
    empty table gives no rows; further columns are ignored.
    """
    spark = messages.sparkSession
    parsed = written(spark, parsed_messages(messages), "quotes-parsed")
    at = written(spark, ranked(spark, parsed.select("c", "turn", "key", "row"), "c", ["turn", "key", "row"], "quotes-ordered")
                 .select("row", "c", "idx", "turn"), "quotes-places")
    per = originals(spark, parsed, at.drop("turn")).groupBy("c", "idx").agg(
        F.count(F.lit(1)).alias("n_linked"), F.min(F.struct("depth", "number", "c2", "idx2")).alias("best"))
    has_previous = F.col("idx") > 0
    nodes = written(spark, at.drop("turn").join(per, ["c", "idx"], "left").select(
        "row", "c", "idx", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.col("best").isNotNull().alias("linked"),
        F.coalesce("best.c2", F.when(has_previous, F.col("c"))).alias("pc"),
        F.coalesce("best.idx2", F.when(has_previous, F.col("idx") - 1)).alias("pidx")), "quotes-nodes")
    order = written(spark, reply_order(spark, nodes.select("c", "idx", "pc", "pidx")), "quotes-order")
    position = ranked(spark, order.select("c", "thread", "path"), "c", ["thread", "path"], "quotes-positions").select(
        "c", F.col("idx").alias("position"), "thread", "path")
    place = ranked(spark, order.select("thread", "c", "path"), "thread", ["path"], "quotes-threads").select(
        "thread", F.col("idx").alias("place"), "c", "path")
    facts = (order.join(position, ["c", "thread", "path"]).join(place, ["thread", "c", "path"]).drop("path")
             .join(nodes, ["c", "idx"])
             .join(at.select(F.col("c").alias("pc"), F.col("idx").alias("pidx"), F.col("turn").alias("parent_turn")),
                   ["pc", "pidx"], "left"))
    out = parsed.join(facts.drop("c"), "row")

    def conversation(x: str) -> Column:
        back = F.when(F.col(x) != NO_CONVERSATION, F.col(x))
        return back.cast(messages.schema["conv_id"].dataType)

    return out.select(
        "conv_id", "turn", "role", "position", F.col("own").alias("text"), conversation("pc").alias("parent_conv"), "parent_turn",
        F.when(F.col("linked"), "quote").when(has_previous, "previous").otherwise("none").alias("link"),
        F.size("quotes").alias("n_quotes"), "n_linked",
        F.coalesce(F.array_max(F.transform("quotes", lambda q: q["depth"])), F.lit(0)).alias("max_depth"),
        conversation("thread").alias("thread"), "place")


def oracle() -> str:
    """DuckDB SQL with the rows of ``link_quotes`` (turns not repeated): the
    same units and proposals, and the order of the paths from the roots."""
    def normal(x):
        return rf"trim(regexp_replace(lower({x}), '[ \t\n\x0B\f\r]+', ' ', 'g'))"

    def units(x):
        parts = rf"string_split_regex({x}, '\n[ \t]*(\r?\n[ \t]*)+')"
        lines = rf"string_split_regex({x}, '\r?\n')"
        ends = rf"list_transform({parts}, lambda p: string_split(regexp_replace({normal('p')}, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)))"
        every = f"list_concat(list_concat([{x}], {parts}), list_concat({lines}, flatten({ends})))"
        return f"list_distinct(list_filter(list_transform({every}, lambda u: {normal('u')}), lambda u: u <> ''))"

    none = f"CAST('{NO_CONVERSATION}' AS BIGINT)"
    return rf"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, coalesce(conv_id, {none}) AS c, coalesce(text, '') AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS idx FROM conversations),
li AS (SELECT c, idx, n, line, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS depth
       FROM (SELECT c, idx, unnest(string_split_regex(t, '\r?\n')) AS line, generate_subscripts(string_split_regex(t, '\r?\n'), 1) AS n
             FROM m WHERE regexp_matches(t, '(^|\n)[ \t]*>'))),
cut AS (SELECT *, sum(CASE WHEN depth IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY c, idx ORDER BY n) AS run
        FROM (SELECT *, lag(depth) OVER (PARTITION BY c, idx ORDER BY n) AS before FROM li)),
runs AS (SELECT c, idx, run, any_value(depth) AS depth, max(run) OVER (PARTITION BY c, idx) AS runs,
                string_agg(regexp_replace(line, '^(?:[ \t]*>)+ ?', ''), chr(10) ORDER BY n) AS body
         FROM cut GROUP BY c, idx, run),
words AS (SELECT c, idx, run, CASE WHEN run < runs THEN regexp_replace(body, '(^|\n)[^>\n]*\b[Ww]rote:[ \t]*\n?[ \t\n\x0B\f\r]*$', '')
                                   ELSE body END AS body FROM runs WHERE depth = 0),
said AS (SELECT c, idx, trim(string_agg(body, chr(10) ORDER BY run), ' ' || chr(9) || chr(13) || chr(10)) AS own
         FROM words WHERE {normal('body')} <> '' GROUP BY c, idx),
o AS (SELECT m.*, CASE WHEN regexp_matches(t, '(^|\n)[ \t]*>') THEN coalesce(own, '') ELSE t END AS own
      FROM m LEFT JOIN said USING (c, idx)),
q AS (SELECT c, idx, row_number() OVER (PARTITION BY c, idx ORDER BY run) AS number, depth, body
      FROM runs WHERE depth > 0 AND {normal('body')} <> ''),
ou AS (SELECT c, idx, unnest({units('own')}) AS u FROM o),
qu AS (SELECT c, idx, number, unnest({units('body')}) AS u FROM q),
firsts AS (SELECT u, min((c, idx)) AS f FROM ou GROUP BY u),
proposed AS (
  SELECT qu.c, qu.idx, number, qu.c AS c2, max(ou.idx) AS idx2 FROM qu JOIN ou ON ou.c = qu.c AND ou.u = qu.u AND ou.idx < qu.idx
  GROUP BY qu.c, qu.idx, number, qu.u
  UNION SELECT qu.c, qu.idx, number, f[1], f[2] FROM qu JOIN firsts USING (u) WHERE f[1] < qu.c),
found AS (SELECT p.*, q.depth FROM proposed p JOIN q ON q.c = p.c AND q.idx = p.idx AND q.number = p.number
          JOIN o ON o.c = c2 AND o.idx = idx2 WHERE contains({normal('own')}, {normal('q.body')})),
best AS (SELECT c, idx, number, depth, min(((CASE WHEN c2 = c THEN 0 ELSE 1 END), c2, (CASE WHEN c2 = c THEN -idx2 ELSE idx2 END))) AS b
         FROM found GROUP BY c, idx, number, depth),
link AS (SELECT c, idx, count(*) AS n_linked, min((depth, number, b[2], abs(b[3]))) AS l FROM best GROUP BY c, idx),
node AS (SELECT o.c, o.idx, coalesce(n_linked, 0) AS n_linked, l IS NOT NULL AS linked,
                CASE WHEN l IS NOT NULL THEN l[3] WHEN o.idx > 0 THEN o.c END AS pc,
                CASE WHEN l IS NOT NULL THEN l[4] WHEN o.idx > 0 THEN o.idx - 1 END AS pidx FROM o LEFT JOIN link USING (c, idx)),
tree AS (SELECT c, idx, c AS thread, [(c, idx)] AS path FROM node WHERE pc IS NULL
         UNION ALL SELECT n.c, n.idx, t.thread, list_append(t.path, (n.c, n.idx))
         FROM node n JOIN tree t ON n.pc = t.c AND n.pidx = t.idx)
SELECT o.conv_id, o.turn, o.role, row_number() OVER (PARTITION BY o.c ORDER BY thread, path) - 1 AS position, o.own AS text,
       nullif(pc, {none}) AS parent_conv, par.turn AS parent_turn,
       CASE WHEN linked THEN 'quote' WHEN o.idx > 0 THEN 'previous' ELSE 'none' END AS link,
       (SELECT count(*) FROM q WHERE q.c = o.c AND q.idx = o.idx) AS n_quotes, n_linked,
       coalesce((SELECT max(depth) FROM q WHERE q.c = o.c AND q.idx = o.idx), 0) AS max_depth, nullif(thread, {none}) AS thread,
       row_number() OVER (PARTITION BY thread ORDER BY path) - 1 AS place
FROM o JOIN node USING (c, idx) JOIN tree USING (c, idx) LEFT JOIN o par ON par.c = pc AND par.idx = pidx
"""
