"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, case folded. Runs of SEED words that a document shares with a test item are the seeds;
each (document, item) that shares one is tiled, and the document is contaminated if its tiles cover at least COVER of the
item's words. Tiles may come in any order, so passages whose parts were moved count as well.

The benchmark, which is a list of test items and does not grow with the corpus, goes to the tasks inside closures, in blocks of at
most BLOCK_WORDS words: seeds meet by a search in a block's sorted table. It is handled by as many passes as it has blocks, and no
task holds more than one block at a time. Documents are never shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import AT_SYMBOL, chunks, hashed_words, ship, table, utf8
from .tiling import condensed, tiles, windows

SEED = 5
COVER = 0.5
BLOCK_WORDS = 2_000_000

_U64 = np.uint64


class Items:
    """Test items by seed. Items of fewer than `seed` words are matched as a whole: their only seed is all their words."""

    def __init__(self, rows: list[tuple], seed: int = SEED):
        self.ids, self.words, self.seed = [], [], seed
        texts = utf8([t for _, t in rows], lower=True)
        for first, end, hashes, offsets in hashed_words(texts, AT_SYMBOL):
            for i in range(end - first):
                if offsets[i + 1] > offsets[i]:
                    self.ids.append(rows[first + i][0])
                    self.words.append(hashes[offsets[i] : offsets[i + 1]])
        self.by_size = {}
        for size in sorted({min(seed, w.size) for w in self.words}):
            found = [(windows(w, size), k) for k, w in enumerate(self.words) if min(seed, w.size) == size]
            keys = np.concatenate([x for x, _ in found])
            owner = np.concatenate([np.full(x.size, k) for x, k in found])
            order = np.argsort(keys, kind="stable")
            bits = np.zeros(1 << 22, bool)
            bits[(keys >> _U64(42)).astype(np.int64)] = True
            self.by_size[size] = keys[order], owner[order], bits

    def overlaps(self, texts: list[bytes], cover: float):
        """(place in texts, item, share of the item's words covered, number of tiles, longest tile) where the share is at least `cover`."""
        for first, _, hashes, offsets in hashed_words(texts, AT_SYMBOL):
            for size, (keys, owner, bits) in self.by_size.items():
                found = windows(hashes, size)
                hit = np.flatnonzero(bits[(found >> _U64(42)).astype(np.int64)])
                lo = np.searchsorted(keys, found[hit])
                real = keys[np.minimum(lo, keys.size - 1)] == found[hit]
                hit, lo = hit[real], lo[real]
                doc = np.searchsorted(offsets, hit, side="right") - 1
                inside = hit + size <= offsets[doc + 1]
                hit, lo, doc = hit[inside], lo[inside], doc[inside]
                cuts = np.flatnonzero(np.diff(doc)) + 1 if doc.size else []
                for at, low, own in zip(np.split(hit, cuts), np.split(lo, cuts), np.split(doc, cuts), strict=True):
                    if not at.size:
                        continue
                    d = int(own[0])
                    words = hashes[offsets[d] : offsets[d + 1]]
                    starts: dict[int, list[int]] = {}
                    high = np.searchsorted(keys, found[at], side="right")
                    for i, a, b in zip(at - offsets[d], low, high, strict=True):
                        for k in set(owner[a:b].tolist()):
                            starts.setdefault(k, []).append(int(i))
                    for k, places in starts.items():
                        text, _ = condensed(words, np.array(places), size)
                        got = tiles(self.words[k], text, size)
                        share = sum(n for _, _, n in got) / self.words[k].size
                        if share >= cover:
                            yield first + d, self.ids[k], share, len(got), max(n for _, _, n in got)


def blocks(benchmark: DataFrame, words: int = BLOCK_WORDS):
    """Rows (item_id, text) of the benchmark in blocks of about `words` words."""
    rows = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    many = max(1, -(-total // words))
    for k in range(many):
        part = rows if many == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == k)
        yield [(r[0], r[1]) for r in part.collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, seed: int = SEED) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, longest_tile of each document and test item that it covers.

    Null and empty documents or items match nothing. Repeated rows give repeated results. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    schema = T.StructType(
        [docs.schema["doc_id"], benchmark.schema["item_id"], T.StructField("coverage", T.DoubleType()), T.StructField("n_tiles", T.IntegerType()), T.StructField("longest_tile", T.IntegerType())]
    )
    out = None
    for rows in blocks(benchmark):
        items = Items(rows, seed)

        def run(batches, items=items):
            import pyarrow as pa

            for whole in batches:
                for batch in chunks(whole):
                    ids = batch.column(0).to_pylist()
                    found = [(ids[d], *rest) for d, *rest in items.overlaps(utf8(batch.column(1).to_pylist(), lower=True), cover)]
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in found], schema=to_arrow)

        from pyspark.sql.pandas.types import to_arrow_schema

        to_arrow = to_arrow_schema(schema)
        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, seed: int = SEED) -> DataFrame:
    """The documents that cover no test item, with all their columns; no shuffle and no join."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")
    for rows in blocks(benchmark):
        items = Items(rows, seed)

        def run(batches, items=items):
            import pyarrow as pa

            for whole in batches:
                for batch in chunks(whole):
                    keep = np.ones(batch.num_rows, bool)
                    keep[[d for d, *_ in items.overlaps(utf8(batch.column(at).to_pylist(), lower=True), cover)]] = False
                    yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents free of test items."""
    return clean(docs, table(spark, sf_dir, "benchmark"))
