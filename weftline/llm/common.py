"""What several operators share: durable intermediates and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Deleting these characters is how texts are normalised, and splitting at them how words are found.
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset a local session gets a temporary folder; on a cluster that would be another folder on every machine, so there it
    is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/weftline/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: a cut of lineage that outlives executors."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_WRITTEN: dict[str, list[str]] = {}


def clean_up(spark: SparkSession) -> int:
    """Removes the tables that this application's operators have written between their steps; results must have been read or written by then."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Names of the columns of a row's identity.
IDENTITY = ("_identity_a", "_identity_b")


def identity() -> list[Column]:
    """128 bits of doc_id and text, never null: rows share them that are the same document, however often it or its doc_id occurs."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64("doc_id", text).alias(IDENTITY[0]), F.xxhash64(F.lit(7), "doc_id", text).alias(IDENTITY[1])]


def picked(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of `docs` whose identity is in `kept`, with all their columns; of rows of one identity any one."""
    a, b = IDENTITY
    rows = docs.select("*", *identity()).join(kept.select(a, b), [a, b], "left_semi")
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(a, b).orderBy(a)))
    return rows.filter("_place = 1").select(*[docs[c] for c in docs.columns])


#: Groups with more than one row in HOT are joined by broadcast; there are fewer than HOT of them.
HOT = 1024


def matched(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Rows with the columns of their group (`key`, its number of rows `size`, and more). Large groups, fewer than HOT, by broadcast.

    So no task of the join holds more than one row in HOT of a single group, however large it is.
    """
    many = F.col(size) * HOT > F.lit(rows.count())
    hot = F.broadcast(groups.filter(many))
    rest = rows.join(hot.select(key), key, "left_anti").join(groups.filter(~many).hint("merge"), key)
    return rows.join(hot, key).unionByName(rest)


def in_fold(key: Column, of: int, remainder: int) -> Column:
    """crc32 of the key's decimal text, modulo `of`, is `remainder`; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % of == remainder


# ---------------------------------------------------------------- words as 64-bit hashes

_BASE = 0x9E3779B97F4A7C15 | 1
_U64 = np.uint64


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, _U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = [_powers(256)]
#: True where a byte parts words.
AT_SPACE = np.zeros(256, bool)
AT_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Letters, digits and bytes of other scripts form words; all else parts them.
AT_SYMBOL = np.ones(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    AT_SYMBOL[_lo:_hi] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply, three rounds)."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _segment_words(buf: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and length of each word of a byte array."""
    at = np.flatnonzero(~apart[buf])
    if not at.size:
        none = np.zeros(0, np.int64)
        return none.astype(_U64), none, none
    new = np.ones(at.size, bool)
    np.not_equal(at[1:], at[:-1] + 1, out=new[1:])
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, at.size))
    if (longest := int(sizes.max())) > _POW[0].size:
        _POW[0] = _powers(1 << longest.bit_length())
    pos = np.arange(at.size) - np.repeat(first, sizes)
    value = np.add.reduceat((buf[at].astype(_U64) + _U64(1)) * _POW[0][pos], first)
    return mix(value), at[first], sizes


def _cuts(data: bytes, limit: int) -> list[bytes]:
    """The text in parts of about `limit` bytes that end at white space."""
    if len(data) <= limit:
        return [data]
    parts, at = [], 0
    while len(data) - at > limit:
        end = max(data.rfind(b" ", at + limit // 2, at + limit), data.rfind(b"\n", at + limit // 2, at + limit))
        if end < 0:
            nxt = [x for x in (data.find(b" ", at + limit), data.find(b"\n", at + limit)) if x >= 0]
            end = min(nxt, default=len(data))
        parts.append(data[at:end])
        at = end
    return [*parts, data[at:]]


def hashed_words(texts: list[bytes], apart: np.ndarray = AT_SPACE, limit: int = 1 << 20):
    """Yields (first, end, hashes, offsets) for runs of texts: texts[first + i] has words hashes[offsets[i]:offsets[i + 1]].

    Runs hold about `limit` bytes, so the working arrays stay small; a longer text is a run of its own and is hashed in parts.
    """
    first = 0
    while first < len(texts):
        end, size = first, 0
        while end < len(texts) and (end == first or size + len(texts[end]) < limit):
            size += len(texts[end]) + 1
            end += 1
        if end == first + 1:
            parts = [_segment_words(np.frombuffer(x, np.uint8), apart)[0] for x in _cuts(texts[first], limit)]
            hashes = parts[0] if len(parts) == 1 else np.concatenate(parts)
            offsets = np.array([0, hashes.size])
        else:
            run = texts[first:end]
            starts = np.cumsum([0] + [len(x) + 1 for x in run])
            hashes, at, _ = _segment_words(np.frombuffer(b" ".join(run) + b" ", np.uint8), apart)
            offsets = np.searchsorted(at, starts)
        yield first, end, hashes, offsets
        first = end


def utf8(texts, lower: bool = False) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    if lower:
        return [b"" if x is None else x.lower().encode("utf-8", "replace") for x in texts]
    return [b"" if x is None else x.encode("utf-8", "replace") for x in texts]


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per context, so workers can import it wherever they run."""
    import os
    import shutil

    context = spark.sparkContext
    if getattr(context, "_weftline_sent", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="weftline-"), "weftline_package"), "zip", os.path.dirname(package), os.path.basename(package))
    context.addPyFile(made)
    context._weftline_sent = True


def chunks(batch, limit: int = 4 << 20):
    """Slices of an Arrow record batch with about `limit` bytes each, so that working memory follows the slice and not the batch."""
    rows = max(1, batch.num_rows)
    each = max(1, int(rows * limit / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, each):
        yield batch.slice(at, each)
