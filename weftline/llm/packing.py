"""Best-fit packing of token pieces by a linear grouping scheme.

A piece is a run of a document's token ids. Lengths are integers of at most the capacity, so everything that has to be
decided is decided on the histogram of lengths, which has at most `capacity` rows at any corpus size:

1. the large lengths are split into groups of equal cardinality and rounded up to the largest of their group;
2. configurations of these few sizes are chosen: for the largest size left, the subset of the other sizes that fills the
   sequence best (subset sums over bounded counts), used as often as the counts allow;
3. the real lengths take the places of the rounded ones;
4. small lengths go where they fit most tightly.

The plan says for each length which ranks go where. Ranks come from counts per (bucket, length) and a window inside each
bucket, so no length, however frequent, meets in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import chunks, materialize, ship, table

CAPACITY = 1024
END_ID = 2
#: Rows that a ranking bucket holds on average.
BUCKET_ROWS = 50_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- tokenising


def byte_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ids of a byte-level BPE vocabulary; ids are in order of the merges, so they serve as ranks."""
    from tokenizers import Tokenizer

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
    return {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items()}


def make_encoder(path: str):
    """text -> the ids that `tokenizers` gives, as little-endian uint32 bytes; strings of special tokens are ordinary text.

    The same vocabulary as ranks encodes a text in a third of the time. Its splitter gives up on runs of about a million white
    space characters; such a text goes to `tokenizers` itself, as a whole.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    bpe = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_ranks(path), special_tokens={})
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True

    def encode(text: str) -> bytes:
        if not text:
            return b""
        try:
            return bpe.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        except ValueError:
            return np.array(slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    return encode


_ENCODERS: dict = {}


def encoder(path: str):
    """One encoder per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = make_encoder(path)
    return _ENCODERS[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones from the end, so only the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids where asked) of every document; null text is empty and still has the end id."""
    tokenizer = tokenizer or default_tokenizer()
    ship(docs.sparkSession)
    key = docs.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", key), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.BinaryType())] * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        import pyarrow as pa

        encode = encoder(tokenizer)
        for whole in batches:
            for batch in chunks(whole):
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = encode(text or "") + end
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + length)]
                        rows.append((doc_id, k, start, length, zlib.crc32(own), *[own] * with_ids))
                columns = list(zip(*rows, strict=True)) or [()] * (5 + with_ids)
                kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names=names[: 5 + with_ids])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))


# ---------------------------------------------------------------- planning on the histogram


def best_subset(sizes: list[int], counts: list[int], room: int) -> dict[int, int]:
    """Index -> copies of the sizes that fill `room` best; larger sizes are preferred among equals."""
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    item = np.full(room + 1, -1, np.int32)
    for i, size in enumerate(sizes):
        if size > room or not counts[i]:
            continue
        layer = reached.copy()
        for _ in range(min(counts[i], room // size)):
            ahead = np.zeros_like(layer)
            ahead[size:] = layer[:-size]
            ahead &= ~reached
            if not ahead.any():
                break
            item[ahead] = i
            reached |= ahead
            layer = ahead
        if reached[room]:
            break
    at, used = int(np.flatnonzero(reached)[-1]), {}
    while at:
        i = int(item[at])
        used[i] = used.get(i, 0) + 1
        at -= sizes[i]
    return used


def grouped(histogram: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Runs [length, count] of each group of equal cardinality, longest first; a group of one length is never split."""
    total = sum(histogram.values())
    each = max(1, -(-total // max(1, groups)))
    out, held = [], 0
    for length in sorted(histogram, reverse=True):
        if not out or held >= each:
            out.append([])
            held = 0
        out[-1].append([length, histogram[length]])
        held += histogram[length]
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = CAPACITY, small: int | None = None) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, first rank, ranks, first sequence, offset): rank first + i of that length goes to sequence + i, at the offset. Also the number of sequences."""
    small = capacity // 10 if small is None else small
    runs = grouped({k: v for k, v in histogram.items() if k > small and v}, groups)
    sizes = [r[0][0] for r in runs]
    counts = [sum(n for _, n in r) for r in runs]
    taken: dict[int, int] = {}
    rows: list[tuple[int, int, int, int, int]] = []
    spare: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first sequence, sequences)
    total = 0

    def place(length: int, n: int, first: int, offset: int) -> None:
        start = taken.get(length, 0)
        rows.append((length, start, n, first, offset))
        taken[length] = start + n

    for big in range(len(sizes)):
        while counts[big]:
            counts[big] -= 1
            used = best_subset(sizes[big:], counts[big:], capacity - sizes[big])
            counts[big] += 1
            config = {big + i: n for i, n in used.items()}
            config[big] = config.get(big, 0) + 1
            times = min(counts[i] // n for i, n in config.items())
            for i, n in config.items():
                counts[i] -= n * times
            while times:  # real lengths for rounded ones, in runs of sequences that look alike
                slots, alike = [], times
                for i, n in config.items():
                    if runs[i][0][1] >= n:
                        alike = min(alike, runs[i][0][1] // n)
                    else:
                        alike = 1
                for i, n in config.items():
                    for _ in range(n):
                        head = runs[i][0]
                        slots.append(head[0])
                        head[1] -= alike
                        if not head[1]:
                            runs[i].pop(0)
                offset = 0
                for length in slots:
                    place(length, alike, total, offset)
                    offset += length
                spare[capacity - offset].append((total, alike))
                total += alike
                times -= alike
    for length in sorted((k for k, v in histogram.items() if 0 < k <= small and v), reverse=True):
        left, room = histogram[length], length
        while left and room <= capacity:
            if not spare[room]:
                room += 1
                continue
            first, n = spare[room].pop()
            use = min(n, left)
            place(length, use, first, capacity - room)
            spare[room - length].append((first, use))
            if n > use:
                spare[room].append((first + use, n - use))
            left -= use
            room = length
        fit = capacity // length
        while left:
            per = min(fit, left)
            n = left // per
            for k in range(per):
                place(length, n, total, k * length)
            spare[capacity - per * length].append((total, n))
            total += n
            left -= n * per
    return rows, total


# ---------------------------------------------------------------- packing


def pack(found: DataFrame, capacity: int = CAPACITY, groups: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length (1 to `capacity`).

    Repeated rows are packed each on its own; among rows of one length any order is as good, so ties cannot change the number
    of sequences. An empty table gives an empty result. Other columns are passed through.
    """
    found = materialize(found, "pieces")
    spark = found.sparkSession
    total = found.count()
    buckets = max(8, -(-total // BUCKET_ROWS))
    keyed = found.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = materialize(keyed.groupBy("_bucket", "length").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    rows, _ = plan(histogram, capacity, groups)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("_bucket", "length").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(before, ["_bucket", "length"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_before"))
    schema = "length long, _first long, _ranks long, _sequence long, offset long"
    places = spark.createDataFrame(rows, schema)  # a few places for each length at most
    on = (ranked["length"] == places["length"]) & (ranked["_rank"] >= places["_first"]) & (ranked["_rank"] < places["_first"] + places["_ranks"])
    return ranked.join(F.broadcast(places), on).select(
        *[ranked[c] for c in found.columns], (F.col("_sequence") + F.col("_rank") - F.col("_first")).alias("sequence_id"), "offset"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents; the last stage, so it returns places instead of documents."""
    return pack(pieces(docs))
