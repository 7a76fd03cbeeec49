"""Near-duplicate lines by a deletion-neighbourhood join.

A line is a sequence of words (lower case, split at white space). Two lines of at least LEAST words are near when one becomes the
other by replacing, inserting or deleting one word; shorter lines are near only when equal. A line is dropped if an earlier line (by
doc_id, then line number) is equal or near; so the earliest stays.

Deleting word i of a line gives a variant; its key hashes the words that stay and i. A line also carries itself as a variant at
every place where a word could have been inserted. Lines that share a key are near each other, every one to every one, so a key's
earliest line stands for all of them. One row per line and key, made and shuffled once, finds the keys of several lines, and only
those meet the lines' places. The distance of what is dropped is verified on the words.

Only a line that has a near one needs variants. Of two lines one edit apart the first or the last words are untouched, so lines
whose ends occur in no other line are left out first, by hashes alone; that is exact.

Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

#: Lines with fewer words have an edit bound of 0.
LEAST = 8


def words_of(line: Column) -> Column:
    """Words of a line."""
    return F.array_remove(F.split(F.lower(line), r"[\x20\x09-\x0D]+"), "")


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line of every line of every row; null text is one empty line."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))


def span(n: Column) -> Column:
    """Words in the ends of a line of n words: the largest power of two up to half of it."""
    return F.pow(F.lit(2.0), F.floor(F.log2(n / F.lit(2.0)))).cast("int")


def ends(words: Column) -> Column:
    """Keys of both ends; a line that is one word above a power of two has those of the shorter length as well, to meet a line of one word less."""
    n = F.size(words)

    def of(p: Column) -> Column:
        return F.array(F.xxhash64(F.lit(1), p, F.slice(words, F.lit(1), p)), F.xxhash64(F.lit(2), p, F.slice(words, n - p + 1, p)))

    p, q = span(n), span(n - 1)
    return F.when((p != q) & (n > LEAST), F.concat(of(p), of(q))).otherwise(of(p))


def chain(ids: Column, seed: int) -> Column:
    """Hashes of the first 0, 1, 2 ... of the ids; each goes on from the one before."""
    return F.aggregate(ids, F.array(F.xxhash64(F.lit(seed))), lambda done, x: F.concat(done, F.array(F.xxhash64(F.element_at(done, -1), x))))


def variants(lines: DataFrame) -> DataFrame:
    """h1, key of the deletion neighbourhood of lines (h1, words): each word deleted, and the line itself at each place of an insertion.

    From hashes of the line's starts (`chain`) and of its ends (`chain` of the reversed line): a variant is a place, what stands before
    it and what comes after it, so a line of n words is hashed twice and not 2n times. Places are rows before they are hashed: what
    runs inside an array is interpreted, what runs on rows is compiled.
    """
    both = lines.select("h1", chain(F.col("words"), 5).alias("starts"), chain(F.reverse("words"), 6).alias("ends"))
    n, v = F.size("starts") - 1, F.col("v")
    rows = both.select("h1", "starts", "ends", F.explode(F.sequence(F.lit(0), 2 * n)).alias("v"))
    i, skipped = F.when(v < n, v).otherwise(v - n), F.when(v < n, 1).otherwise(0)
    return rows.select("h1", F.xxhash64(i, F.get("starts", i), F.get("ends", n - i - skipped)).alias("key"))


def within_one(a: Column, b: Column) -> Column:
    """The word arrays are at most one edit apart: common start and common end cover all but one word of the longer."""
    n, m = F.size(a), F.size(b)
    short = F.least(n, m)
    steps = F.sequence(F.lit(1), short)
    start = F.coalesce(F.array_min(F.filter(steps, lambda i: F.element_at(a, i) != F.element_at(b, i))) - 1, short)
    end = F.coalesce(F.array_min(F.filter(steps, lambda i: F.element_at(a, -i) != F.element_at(b, -i))) - 1, short)
    return (F.abs(n - m) <= 1) & (start + end >= F.greatest(n, m) - 1)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, keep_doc_id, keep_line_no, kept of every line.

    keep_* is the earliest line that is equal or near (the line itself if it stays); being near does not carry over, so that line may
    itself go for a still earlier one. Lines without words always stay. A null doc_id
    comes last; rows that repeat a doc_id share its line numbers, and where such lines have one text each counts as the same line.
    An empty table gives an empty result; other columns are not read.
    """
    lines = lines_of(docs).withColumn("words", words_of(F.col("line"))).drop("line")
    ref = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("line_no"))
    lines = lines.select(ref.alias("ref"), "words", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(3), "words").alias("h2"), F.size("words").alias("n"))
    keyed = lines.withColumn("ends", F.when(F.col("n") >= LEAST, ends(F.col("words"))))
    slim = materialize(keyed.select("ref", "h1", "h2", "n", "ends"), "lines")
    tips = slim.filter(F.col("n") >= LEAST).select("h1", F.explode("ends").alias("key"))
    shared = tips.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("key")
    alive = tips.join(shared, "key", "left_semi").select("h1").distinct()
    firsts = slim.filter(F.col("n") >= LEAST).groupBy("h1", "h2").agg(F.min("ref").alias("ref"))
    wanted = firsts.join(alive, "h1", "left_semi").groupBy("ref.doc_id").agg(F.collect_set("ref.line_no").alias("_lines")).withColumnRenamed("doc_id", "_doc")
    texts = docs.select("doc_id", "text")
    texts = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["_doc"])).select("doc_id", "_lines", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))
    texts = texts.filter(F.array_contains("_lines", F.col("line_no"))).select("doc_id", "line_no", words_of(F.col("line")).alias("words"))
    texts = texts.select(F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(3), "words").alias("h2"), ref.alias("ref"), "words")
    alive = materialize(texts.filter(F.size("words") >= LEAST).groupBy("h1", "h2").agg(F.min("ref").alias("ref"), F.first("words").alias("words")), "alive")
    each = Window.partitionBy("key")
    met = variants(alive).withColumns({"a": F.min("h1").over(each), "b": F.max("h1").over(each)}).filter("a <> b").select("key", "h1")
    found = met.join(alive.select("h1", "ref"), "h1").withColumn("lead", F.min(F.struct("ref", "h1")).over(each)).filter("lead.h1 <> h1").groupBy("h1").agg(F.min("lead").alias("lead"))
    pairs = found.join(alive, "h1").filter(F.col("lead.ref") < F.col("ref")).select("h1", "h2", "words", "lead")
    leads = alive.select(F.col("h1").alias("l1"), F.col("words").alias("other"))
    near = pairs.join(leads, F.col("lead.h1") == F.col("l1")).filter(within_one(F.col("words"), F.col("other"))).select("h1", "h2", F.col("lead.ref").alias("near")).groupBy("h1", "h2").agg(F.min("near").alias("near"))
    first = slim.filter("n > 0").groupBy("h1", "h2").agg(F.min("ref").alias("first"))
    best = first.join(near, ["h1", "h2"], "left").select("h1", "h2", F.least("first", F.coalesce("near", "first")).alias("keep"))
    out = slim.filter("n > 0").join(best, ["h1", "h2"]).select("ref", "keep").unionByName(slim.filter("n = 0").select("ref", F.col("ref").alias("keep")))
    return out.select("ref.doc_id", "ref.line_no", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.line_no").alias("keep_line_no"), (F.col("ref") == F.col("keep")).alias("kept"))


def without_dropped(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """doc_id, text of each document with its dropped lines taken out."""
    gone = marks.filter("NOT kept").groupBy("doc_id").agg(F.collect_set("line_no").alias("_gone"))
    gone = gone.withColumnRenamed("doc_id", "_id")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    left = F.filter(lines, lambda x, i: ~F.array_contains(F.coalesce("_gone", F.array().cast("array<int>")), i))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]), "left").select(docs["doc_id"], F.array_join(left, "\n").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH l AS (
  SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS line_no, unnest(s) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)
), w AS (
  SELECT doc_id, line_no, list_filter(regexp_split_to_array(lower(line), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM l
), r AS (
  SELECT *, len(words) AS n, row_number() OVER (ORDER BY doc_id, line_no) AS pos FROM w
), t AS (
  SELECT words, any_value(n) AS n, min(pos) AS pos FROM r WHERE n > 0 GROUP BY words
), k AS (
  SELECT pos, i AS place, list_concat(words[1:i], words[i + 2:]) AS rest FROM t, LATERAL (SELECT unnest(range(0, n)) AS i) WHERE n >= {LEAST}
  UNION ALL
  SELECT pos, i AS place, words AS rest FROM t, LATERAL (SELECT unnest(range(0, n + 1)) AS i) WHERE n >= {LEAST}
), g AS (
  SELECT pos, min(pos) OVER (PARTITION BY place, rest) AS lead FROM k
), b AS (
  SELECT pos, min(lead) AS lead FROM g GROUP BY pos
), f AS (
  SELECT r.doc_id, r.line_no, r.pos, CASE WHEN r.n = 0 THEN r.pos ELSE coalesce(least(t.pos, b.lead), t.pos) END AS keep
  FROM r LEFT JOIN t ON r.n > 0 AND r.words = t.words LEFT JOIN b ON t.pos = b.pos
)
SELECT f.doc_id, f.line_no, o.doc_id AS keep_doc_id, o.line_no AS keep_line_no, f.pos = f.keep AS kept
FROM f JOIN r o ON o.pos = f.keep
"""
