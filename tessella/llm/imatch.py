"""I-Match document fingerprints.

Terms whose inverse document frequency lies in a chosen band make up the
lexicon; the document's distinct lexicon terms are sorted and hashed once for
each of several randomised subsets of the lexicon.  Subsets come in
``CELLS``: at a level with ``c`` cells a term falls into one cell by its hash
and the first ``SUBSETS`` cells are used, so a subset keeps ``1/c`` of the
lexicon.  Coarse levels serve short documents, fine levels long ones.

Everything is DataFrame expressions.  The lexicon has at most
``mean distinct terms per document / least share`` terms whatever the size of
the corpus (a term must be in that share of documents), so it may be
broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut, id_bounds, range_of, words_column

LEAST_SHARE, MOST_SHARE = 0.001, 0.01     # document frequency over documents
IDF_BAND = (-math.log(MOST_SHARE), -math.log(LEAST_SHARE))
CELLS = (32, 128, 512, 2048)
SUBSETS = 16
SLOTS = SUBSETS * len(CELLS)
HEX = 4                    # hexadecimal digits kept of each subset's hash
EMPTY = "-" * HEX
BUCKET_ROWS = 512          # documents ordered at a time
MAX_BUCKETS = 100_000
MAX_BROADCAST_TERMS = 4_000_000
MARK = "\n"                # no word holds a line end


def terms(text):
    """Distinct terms of a text: lower-cased words."""
    return F.array_distinct(words_column(F.lower(text)))


def lexicon(docs: DataFrame, n_docs: int, band=(LEAST_SHARE, MOST_SHARE)) -> DataFrame:
    """``(term, code)``: one row per subset a term is in; ``code`` is the
    subset's number and 52 bits of the term's hash in one integer."""
    least, most = band
    df = (docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").count()
          .where((F.col("count") >= least * n_docs) & (F.col("count") <= max(most * n_docs, 2.0))))
    h = F.conv(F.substring(F.md5(F.col("term").cast("binary")), 1, 13), 16, 10).cast("long")
    pick = F.conv(F.substring(F.md5(F.col("term").cast("binary")), 14, 8), 16, 10).cast("long")
    coded = df.withColumn("h", h).withColumn("pick", pick)
    cells, turn = [], 1
    for level, c in enumerate(CELLS):
        cell = F.floor(F.col("pick") / turn) % c
        cells.append(F.when(cell < SUBSETS, cell + level * SUBSETS))
        turn *= c
    return (coded.withColumn("slot", F.explode(F.array(*cells))).where("slot is not null")
            .select("term", (F.shiftleft(F.col("slot").cast("long"), 52).bitwiseOR(F.col("h"))).alias("code")))


def with_next(docs: DataFrame, n_docs: int) -> DataFrame:
    """Adds the next document's key and text in descending id order and the
    row's number ``n`` in its bucket; after the last comes the first.  Null ids come last; equal ids go by a hash of
    the text.  Rows are ordered within buckets of ids; each bucket also gets
    the first row of the bucket that follows."""
    bounds = id_bounds(docs, min(math.ceil(n_docs / BUCKET_ROWS), MAX_BUCKETS))
    last = len(bounds)
    rows = docs.select("doc_id", "key", "text", range_of(bounds).cast("int").alias("bucket"))
    head = (rows.groupBy("bucket").agg(F.max_by(F.struct("doc_id", "key", "text"),
                                                F.struct("doc_id", "key")).alias("h"))
            .select("h.doc_id", "h.key", "h.text",
                    F.when(F.col("bucket") == last, 0).otherwise(F.col("bucket") + 1).alias("bucket"),
                    F.lit(1).alias("after")))
    all_ = rows.withColumn("after", F.lit(0)).unionByName(head)
    w = Window.partitionBy("bucket").orderBy("after", F.col("doc_id").desc_nulls_last(), F.col("key").desc())
    return (all_.withColumn("next_id", F.lead("doc_id").over(w)).withColumn("next_key", F.lead("key").over(w))
            .withColumn("next_text", F.lead("text").over(w)).withColumn("n", F.row_number().over(w))
            .where("after = 0").drop("after"))


def likeness(a, b):
    """Likeness of two fingerprints, 0 to 1: equal ones have 1; else the best
    level's share of equal subset hashes among those not empty in both,
    counting at least four."""
    def level(k):
        lo = k * SUBSETS
        at = [lo + j for j in range(SUBSETS)]
        x = [F.substring(a, i * HEX + 1, HEX) for i in at]
        y = [F.substring(b, i * HEX + 1, HEX) for i in at]
        same = sum([F.when((p == q) & (p != EMPTY), 1).otherwise(0) for p, q in zip(x, y)], F.lit(0))
        any_ = sum([F.when((p != EMPTY) | (q != EMPTY), 1).otherwise(0) for p, q in zip(x, y)], F.lit(0))
        return same / F.greatest(any_, F.lit(4))
    plain = a.startswith("t") | b.startswith("t")
    return F.when(a == b, 1.0).when(plain, 0.0).otherwise(
        F.greatest(*[level(k) for k in range(len(CELLS))])).cast("double")


def signature(codes, whole):
    """Fingerprint of sorted lexicon codes: one hash per subset; a text
    without lexicon terms gets the hash of all its terms."""
    one = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda s: F.filter(
        codes, lambda c: F.shiftright(c, 52) == s))
    hashes = F.transform(one, lambda part: F.when(F.size(part) == 0, EMPTY).otherwise(
        F.substring(F.md5(F.array_join(part.cast("array<string>"), ",").cast("binary")), 1, HEX)))
    return F.when(F.size(codes) == 0, F.concat(F.lit("t"), whole)).otherwise(F.array_join(hashes, ""))


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next)`` per row.

    The edited text has its last third (rounded down, in code points)
    replaced by the first as many code points of the next document in
    descending id order.  Null texts count as empty, also as the next one;
    equal texts have equal fingerprints; a single document is its own next;
    repeated rows stay; an empty table gives no rows; further columns are
    ignored.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    texts = texts.withColumn("key", F.xxhash64("text"))
    n_docs = docs.count()
    lex = cut(spark, lexicon(texts, n_docs))
    n_terms = lex.count()
    third = F.floor(F.char_length("text") / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 3) as int))"),
                      F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third))
    pairs = with_next(texts, n_docs).withColumn("edited", edited)
    keys = ["bucket", "n", "doc_id", "key", "next_id", "next_key"]
    # one more "term" per text that no word equals brings its facts along
    lex = lex.unionByName(spark.createDataFrame([(MARK, -1)], "term string, code long"))
    if n_terms <= MAX_BROADCAST_TERMS:
        lex = F.broadcast(lex)
    exploded = (pairs.withColumn("v", F.explode(F.array(
        F.struct(F.lit(0).alias("which"), F.col("text").alias("t")),
        F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))))
        .select(*keys, "v.which", F.col("v.t").alias("t"), terms(F.col("v.t")).alias("terms"))
        .select(*keys, "which", F.char_length("t").cast("long").alias("n_chars"),
                F.sha2(F.col("t").cast("binary"), 256).alias("sha"),
                F.md5(F.array_join(F.array_sort("terms"), " ").cast("binary")).alias("whole"),
                F.concat("terms", F.array(F.lit(MARK))).alias("terms"))
        # on its own: what is selected beside a generator is carried and
        # computed once for each of its rows
        .select(*keys, "which", "n_chars", "sha", "whole", F.explode("terms").alias("term")))
    facts = F.when(F.col("term") == MARK, F.struct("n_chars", "sha", "whole"))
    sigs = (exploded.select(*keys, "which", "term", facts.alias("f")).join(lex, "term")
            .groupBy(*keys, "which").agg(F.sort_array(F.collect_set("code")).alias("codes"), F.max("f").alias("f"))
            .select(*keys, "which", "f.n_chars", "f.sha",
                    signature(F.filter("codes", lambda c: c >= 0), F.col("f.whole")).alias("fp")))
    wide = cut(spark, sigs.groupBy(*keys).agg(
        *[F.max(F.when(F.col("which") == 0, F.col(c))).alias(f"{c}0") for c in ("n_chars", "fp")],
        *[F.max(F.when(F.col("which") == 1, F.col(c))).alias(f"{c}1") for c in ("sha", "fp")]))
    nexts = wide.select(F.col("doc_id").alias("ni"), F.col("key").alias("nk"),
                        F.col("fp0").alias("next_fp")).dropDuplicates(["ni", "nk"])
    return (wide.join(nexts, F.col("next_id").eqNullSafe(F.col("ni")) & (F.col("next_key") == F.col("nk")), "left")
            .select("doc_id", F.col("n_chars0").alias("n_chars"), F.col("sha1").alias("edited_sha256"),
                    F.col("fp0").alias("fingerprint"), F.col("fp1").alias("edited_fingerprint"),
                    likeness(F.col("fp0"), F.col("fp1")).alias("near_edited"),
                    likeness(F.col("fp0"), F.col("next_fp")).alias("near_next")))


def oracle(band=(LEAST_SHARE, MOST_SHARE)) -> str:
    """DuckDB SQL with the rows of ``fingerprints`` (ids not repeated)."""
    least, most = band
    def words(t):
        return (rf"list_distinct(list_filter(string_split_regex(lower({t}), '[\x20\x09-\x0D]+'), "
                "lambda w: w <> ''))")

    picks, turn = [], 1
    for level, c in enumerate(CELLS):
        picks.append(f"CASE WHEN (pick // {turn}) % {c} < {SUBSETS} THEN (pick // {turn}) % {c} + {level * SUBSETS} END")
        turn *= c
    def near(a, b):
        levels = []
        for k in range(len(CELLS)):
            def n(cond, k=k):
                return (f"len(list_filter(range({k * SUBSETS}, {(k + 1) * SUBSETS}), lambda i: {cond}))::DOUBLE").replace(
                    "X", f"substr({a}, (i * {HEX} + 1)::INT, {HEX})").replace("Y", f"substr({b}, (i * {HEX} + 1)::INT, {HEX})")
            same = n(f"X = Y AND X <> '{EMPTY}'")
            any_ = n(f"X <> '{EMPTY}' OR Y <> '{EMPTY}'")
            levels.append(f"{same} / greatest({any_}, 4)")
        return (f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {a}[1] = 't' OR {b}[1] = 't' THEN 0.0::DOUBLE "
                f"ELSE greatest({', '.join(levels)}) END")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM documents),
nx AS (SELECT *, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id,
              coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text
       FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
ed AS (SELECT *, substr(text, 1, (n_chars - n_chars // 3)::INT) || substr(next_text, 1, (n_chars // 3)::INT) AS edited FROM nx),
df AS (SELECT term, count(*) AS c FROM (SELECT unnest({words('text')}) AS term FROM d) GROUP BY term),
lex AS (SELECT term, ('0x' || substr(md5(term), 1, 13))::BIGINT AS h, ('0x' || substr(md5(term), 14, 8))::BIGINT AS pick
        FROM df WHERE c >= {least} * (SELECT count(*) FROM d) AND c <= greatest({most} * (SELECT count(*) FROM d), 2.0)),
coded AS (SELECT * FROM (SELECT term, h, unnest([{', '.join(picks)}]) AS slot FROM lex) WHERE slot IS NOT NULL),
v AS (SELECT doc_id, 0 AS which, text AS t FROM ed UNION ALL SELECT doc_id, 1, edited FROM ed),
tt AS (SELECT doc_id, which, t, {words('t')} AS terms FROM v),
hits AS (SELECT doc_id, which, slot, substr(md5(string_agg((slot * 4503599627370496 + h)::VARCHAR, ',' ORDER BY h)), 1, {HEX}) AS sig
         FROM (SELECT DISTINCT doc_id, which, slot, h FROM (SELECT doc_id, which, unnest(terms) AS term FROM tt) JOIN coded USING (term))
         GROUP BY ALL),
anyhit AS (SELECT DISTINCT doc_id, which FROM hits),
full_ AS (SELECT doc_id, which, string_agg(coalesce(sig, '{EMPTY}'), '' ORDER BY slot) AS fp
          FROM (SELECT doc_id, which, s.slot, sig FROM (SELECT *, unnest(range({SLOTS})) AS slot FROM anyhit) s
                LEFT JOIN hits USING (doc_id, which, slot)) GROUP BY doc_id, which),
fps AS (SELECT tt.doc_id, tt.which, coalesce(fp, 't' || md5(array_to_string(list_sort(terms), ' '))) AS fp
        FROM tt LEFT JOIN full_ USING (doc_id, which)),
f0 AS (SELECT doc_id, fp FROM fps WHERE which = 0), f1 AS (SELECT doc_id, fp FROM fps WHERE which = 1)
SELECT ed.doc_id, n_chars, sha256(edited) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint,
       {near('a.fp', 'b.fp')} AS near_edited, {near('a.fp', 'c.fp')} AS near_next
FROM ed JOIN f0 a USING (doc_id) JOIN f1 b ON b.doc_id = ed.doc_id JOIN f0 c ON c.doc_id = ed.next_id
"""
