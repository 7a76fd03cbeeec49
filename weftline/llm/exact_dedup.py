"""Exact deduplication against a persistent digest index.

The index is a table in the warehouse, bucketed and sorted by digest, with one row per distinct text and a partition per batch. New
data is reduced to one row per digest (partial aggregation runs before the shuffle, so a text with millions of copies is a few rows
per task), joined to the index by a sort-merge anti-join that needs no exchange on the index's side, and what is new is appended as
the batch's partition. The result is then read from the index. A batch that runs again replaces its own partition and nothing
else, so a job that is retried gives the same rows.

Rows find their group's entry by a join on the digest. Groups that hold more than one in HOT rows, of which there are fewer than
HOT, are broadcast instead, so no task of the join holds more than that share however large a group of copies is.

Only DataFrame functions run here.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IDENTITY, SPACE_CHARS, identity, matched, materialize, picked, table

def normalised(text: Column) -> Column:
    """The text without white space characters; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS, "")


class DigestIndex:
    """A digest index kept in the warehouse: text_sha256, doc_id, group_size, batch.

    `buckets` sets how many sorted buckets a batch is written in when the index is made: the session's shuffle partitions if unset.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name = spark, name
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def create(self, key: str = "bigint") -> None:
        """Makes the empty index where there is none."""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (text_sha256 STRING, doc_id {key}, group_size BIGINT, batch STRING) USING parquet "
            f"PARTITIONED BY (batch) CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {self.buckets} BUCKETS"
        )

    def read(self) -> DataFrame:
        return self.spark.read.table(self.name)

    def others(self, batch: str) -> DataFrame:
        """The entries of all batches but this one."""
        return self.read().filter(F.col("batch") != batch)

    def put(self, rows: DataFrame, batch: str) -> None:
        """Makes the rows (text_sha256, doc_id, group_size) the batch's partition, in place of what it held; a write that fails changes nothing."""
        view = f"digests_{uuid.uuid4().hex}"
        rows.select("text_sha256", "doc_id", "group_size").createOrReplaceTempView(view)
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = '{batch}') SELECT text_sha256, doc_id, group_size FROM {view}")
        self.spark.catalog.dropTempView(view)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digests(docs: DataFrame) -> DataFrame:
    """row (any unique number), doc_id, code points of the original text, the digest of the normalised one, and the row's identity."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.char_length(text).cast("long").alias("n_points"),
        F.sha2(F.encode(normalised(F.col("text")), "UTF-8"), 256).alias("text_sha256"),
        *identity(),
    )


def grouped(rows: DataFrame) -> DataFrame:
    """text_sha256, keep (row and doc_id of the row that stays), group_size."""
    order = F.struct(-F.col("n_points"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    return rows.groupBy("text_sha256").agg(F.min_by(F.struct("row", "doc_id"), order).alias("keep"), F.count(F.lit(1)).alias("group_size"))


def marked(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """What `dedup` returns, with the rows' identities."""
    index.create(docs.schema["doc_id"].dataType.simpleString())
    rows = materialize(digests(docs), "digests")
    groups = materialize(grouped(rows), "groups")
    new = materialize(groups.join(index.others(batch).select("text_sha256").hint("merge"), "text_sha256", "left_anti"), "new-digests")
    index.put(new.select("text_sha256", F.col("keep.doc_id").alias("doc_id"), "group_size"), batch)
    entries = index.read().select("text_sha256", F.col("doc_id").alias("keep_id"), (F.col("batch") != batch).alias("known"))
    found = groups.join(entries.hint("merge"), "text_sha256").select("text_sha256", "keep_id", "group_size", "known", F.col("keep.row").alias("_keep"))
    return matched(rows, found, "text_sha256", "group_size").select("doc_id", "keep_id", "group_size", ((F.col("row") == F.col("_keep")) & ~F.col("known")).alias("kept"), "text_sha256", "known", *IDENTITY)


def dedup(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """Marks each row of `docs` as kept or dropped and adds the new digests to the index, as the batch's entries.

    Returns a row per input row: doc_id, keep_id, group_size, kept, text_sha256, known. Of equal texts that no other batch of the
    index holds, one row stays: that with the most code points, then the smallest doc_id (a null doc_id comes last); of rows equal
    in both, any one. Where another batch holds the text, keep_id is the indexed doc_id and no new row stays. Running a batch again
    gives the same rows and leaves the same index. Null text is empty text; empty texts equal each other. An empty table gives an
    empty result. Columns other than doc_id and text are not read.
    """
    return marked(docs, index, batch or uuid.uuid4().hex).drop(*IDENTITY)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    out = materialize(dedup(table(spark, sf_dir, "documents"), index, "documents").drop("known"), "exact-dedup")
    index.drop()  # it served this call alone
    return out


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts, also where doc_ids repeat."""
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    kept = materialize(marked(docs, index, "documents").filter("kept").select(*IDENTITY), "exact-kept")
    index.drop()
    return picked(docs, kept)


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
