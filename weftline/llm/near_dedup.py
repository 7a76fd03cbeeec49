"""Near-duplicate classes: ProbMinHash signatures of equal weights, banding, exact verification, connected components.

Similarity is the Jaccard similarity of sets of five-word shingles (lower case, split at white space); documents are linked
at THRESHOLD or more, and a class is a connected component of links. Documents with equal sets are one node from the start.

Candidates are the members of a band bucket. The registers weigh all shingles alike, so that two documents agree in a register
with the similarity that is verified: a pair at THRESHOLD shares no band with a probability of (1 - THRESHOLD^ROWS)^BANDS, 3 in a
million, and a nearer one with less, however often a line is repeated in either. Every pair that is compared is verified exactly. Pairs inside a bucket are never listed as such:
* every member is verified against the bucket's leader, the member first by a hash order that all buckets share, so the same
  pairs come up in all bands and are verified once;
* where that leaves a bucket in several parts, the members outside its largest part are compared with all members, in tiles
  of bounded size. A tile holds the members' sets, counts what each of its queries shares with all of them at once, and
  returns links between parts that were apart, never more than it has parts.
So every pair of a bucket whose members are not already connected is compared, whatever the size of the bucket.

Joins with tables that grow with the corpus are sort-merge joins whatever their size, so that shuffles grow in proportion to the input.

Components are found by alternating large-star and small-star steps; every step is a shuffle by node with hubs reduced before.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import AT_SPACE, HOT, IDENTITY, chunks, hashed_words, identity, matched, materialize, mix, picked, ship, table, utf8
from .minhash import SHINGLE, bands, shingles, signatures

THRESHOLD = 0.8
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: Parts that the pairs of a very frequent leader are dealt over.
SALTS = 64
#: Queries and members that a tile compares, on average.
QUERIES, MEMBERS = 256, 1024

_U64 = np.uint64
NODE = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("key", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def node_of(found: np.ndarray) -> bytes:
    """A 128-bit fingerprint of a set of shingles."""
    a, b = mix(found).sum(dtype=_U64), mix(found ^ _U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=_U64)
    return mix(np.array([a + _U64(found.size), b], _U64)).tobytes()


def sketches(docs: DataFrame) -> DataFrame:
    """row (any unique number), doc_id, identity, node, key (the first 64 bits of node), n, bands of every row. Null text is empty; texts without words share one node with no bands."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in chunks(whole):
                nodes, counts, found = [], [], []
                for first, end, hashes, offsets in hashed_words(utf8(batch.column(4).to_pylist(), lower=True), AT_SPACE):
                    own = [np.unique(shingles(hashes[offsets[i] : offsets[i + 1]])) for i in range(end - first)]
                    at = np.cumsum([0] + [e.size for e in own])
                    sig = signatures(np.concatenate(own), np.ones(at[-1]), at, REGISTERS)
                    nodes += [node_of(e) for e in own]
                    counts += np.diff(at).tolist()
                    found += [b if e.size else [] for b, e in zip(bands(sig, ROWS), own, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:4], pa.array(nodes, pa.binary()), pa.array(np.frombuffer(b"".join(nodes), np.int64)[::2]), pa.array(counts, pa.int32()), pa.array(found, pa.list_(pa.int64()))],
                    names=["row", "doc_id", *IDENTITY, "node", "key", "n", "bands"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", *identity(), "text")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:4], *NODE.fields]))


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, sh (sorted 32-bit shingle hashes) of the wanted nodes, each given with the identity of a row that has it."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in chunks(whole):
                nodes, out = batch.column(1).to_pylist(), []
                for first, end, hashes, offsets in hashed_words(utf8(batch.column(0).to_pylist(), lower=True), AT_SPACE):
                    for i in range(end - first):
                        found = np.unique(shingles(hashes[offsets[i] : offsets[i + 1]]))
                        if node_of(found) == nodes[first + i]:
                            out.append((nodes[first + i], np.unique((found >> _U64(32)).astype(np.uint32)).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], names=["node", "sh"])

    rows = docs.select(*identity(), "text").join(wanted.hint("merge"), [*IDENTITY]).select("text", "node")
    found = rows.mapInArrow(run, "node binary, sh binary")
    return found.groupBy("node").agg(F.min("sh").alias("sh"))


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if not x.size and not y.size:
        return 1.0
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (both.size - common)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold.

    A leader b of more than one pair in HOT, of which there are fewer than HOT, has its pairs dealt over SALTS parts.
    """

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in chunks(whole):
                same = [jaccard(x, y) >= THRESHOLD for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                yield batch.select([0, 1]).filter(pa.array(same, pa.bool_()))

    pairs = materialize(pairs, "pairs")
    hot = F.broadcast(pairs.groupBy("b").count().filter(F.col("count") * HOT > F.lit(pairs.count())).select("b", F.lit(SALTS).alias("salts")))
    rows = pairs.join(sets.select(F.col("node").alias("a"), F.col("sh").alias("sa")).hint("merge"), "a").join(hot, "b", "left")
    rows = rows.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("a"), F.col("salts")).cast("int"), F.lit(0)))
    leads = sets.select(F.col("node").alias("b"), F.col("sh").alias("sb")).join(pairs.select("b").distinct().hint("merge"), "b", "left_semi").join(hot, "b", "left")
    leads = leads.select("b", "sb", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)).alias("salt"))
    return rows.join(leads.hint("merge"), ["b", "salt"]).select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def tile(group):
    """Links between different parts that the queries of a tile have with its members."""
    import pyarrow as pa

    node, part, role, sets = (group.column(k).to_pylist() for k in ("node", "part", "role", "sh"))
    own = [np.frombuffer(x, np.uint32) for x in sets]
    members = [i for i, r in enumerate(role) if r & 1 and own[i].size]
    out, root = [], {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    if members:
        size = np.array([own[i].size for i in members])
        known, place = np.unique(np.concatenate([own[i] for i in members]), return_inverse=True)
        first = np.cumsum(size) - size
        for q in (i for i, r in enumerate(role) if r & 2 and own[i].size):
            at = np.minimum(np.searchsorted(known, own[q]), known.size - 1)
            mark = np.zeros(known.size, np.int32)
            mark[at[known[at] == own[q]]] = 1
            common = np.add.reduceat(mark[place], first)
            for hit in np.flatnonzero(common >= THRESHOLD * (size + own[q].size - common)).tolist():
                m = members[hit]
                a, b = find(part[q]), find(part[m])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((node[q], node[m]))
    return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([x for _, x in out], pa.binary())})


def strays(members: DataFrame, parts: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between a bucket's members outside its largest part and all its members. members: band, node, lead (boolean).

    Leaders have met all members already. Buckets of the same members count once.
    """
    rows = members.join(parts.hint("merge"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    rows = materialize(rows.select("band", "node", "part", "lead"), "members")
    one, two = F.xxhash64("node"), F.xxhash64(F.lit(1), "node")
    sizes = rows.groupBy("band", "part").agg(F.count(F.lit(1)).alias("c"), F.count_if("lead").alias("l"), F.sum(one.cast("decimal(38,0)")).alias("x"), F.sum(two.cast("decimal(38,0)")).alias("y"))
    sizes = sizes.groupBy("band").agg(F.max_by(F.struct("part", "c", "l"), F.struct("c", "part")).alias("main"), F.sum("c").alias("k"), F.sum("l").alias("l"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    sizes = sizes.select("band", "k", "x", "y", F.col("main.part").alias("main"), (F.col("k") - F.col("main.c") - F.col("l") + F.col("main.l")).alias("s")).filter("s > 0 and k > 2")
    sizes = sizes.join(sizes.groupBy("k", "x", "y").agg(F.min("band").alias("band")).select("band"), "band", "left_semi")
    rows = rows.join(sizes.select("band", "k", "s", "main"), "band")
    asks = (F.col("part") != F.col("main")) & ~F.col("lead")
    nq, nm, own = F.ceil(F.col("s") / QUERIES).cast("int"), F.ceil(F.col("k") / MEMBERS).cast("int"), F.xxhash64("node")
    qt, mt = F.pmod(own, nq).cast("int"), F.pmod(own, nm).cast("int")
    spot = lambda q, m, r: F.struct(q.alias("qt"), m.alias("mt"), F.lit(r).alias("role"))
    as_member = F.transform(F.sequence(F.lit(0), nq - 1), lambda q: F.struct(q.alias("qt"), mt.alias("mt"), F.when(asks & (q == qt), 3).otherwise(1).alias("role")))
    as_query = F.filter(F.transform(F.sequence(F.lit(0), nm - 1), lambda m: spot(qt, m, 2)), lambda x: asks & (x["mt"] != mt))
    spots = rows.select("band", "node", "part", F.explode(F.concat(as_member, as_query)).alias("at")).select("band", "node", "part", "at.*")
    return spots.join(sets.hint("merge"), "node").select("band", "qt", "mt", "node", "part", "role", "sh").groupBy("band", "qt", "mt").applyInArrow(tile, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node, part of every node with a link; part is the smallest node of its component."""
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("part")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("part")).distinct())
        before = now


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, kept of every row; class_id is the smallest doc_id of the class (null only where all are null).

    One row of a class is kept: the one with class_id; of several such rows any one. Null text is empty text, and texts without
    words form one class. An empty table gives an empty result. Other columns are not read.
    """
    return labelled(docs).drop(*IDENTITY)


def labelled(docs: DataFrame) -> DataFrame:
    """What `classes` returns, with the rows' identities."""
    found = materialize(sketches(docs), "sketches")
    every = found.groupBy("key", "node").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.min(F.struct(*IDENTITY)).alias("of"), F.count(F.lit(1)).alias("copies"))
    every = materialize(every, "nodes")
    spread = every.select("key", F.explode("bands").alias("band"))
    buckets = spread.groupBy("band").agg(F.min("key").alias("lead"), F.max("key").alias("other")).filter("lead <> other").drop("other")
    members = materialize(spread.join(buckets, "band"), "buckets")
    nodes = materialize(every.drop("bands", "copies").join(members.select("key").distinct(), "key", "left_semi"), "shared")
    sets = materialize(sets_of(docs, nodes.select("of.*", "node")), "sets")
    side = lambda c: nodes.select(F.col("key").alias(f"k{c}"), F.col("node").alias(c), F.col("n").alias(f"n{c}")).hint("merge")
    star = members.select(F.col("key").alias("ka"), F.col("lead").alias("kb")).distinct().filter("ka <> kb").join(side("a"), "ka").join(side("b"), "kb")
    star = star.filter(F.least("na", "nb") >= THRESHOLD * F.greatest("na", "nb")).select("a", "b")
    links = materialize(verified(star, sets), "links")
    first = links.groupBy("a").agg(F.min("b").alias("b"))
    ahead = first.select(F.col("a").alias("b"), F.col("b").alias("c"))
    parts = first.join(ahead, "b", "left").select(F.col("a").alias("node"), F.coalesce("c", "b").alias("part"))
    more = strays(members.join(nodes.select("key", "node").hint("merge"), "key").select("band", "node", (F.col("key") == F.col("lead")).alias("lead")), parts, sets)
    part = components(links.unionByName(more))
    parted = materialize(every.select("node", "copies").join(part, "node", "left").select("node", "copies", F.coalesce("part", "node").alias("part")), "parts")
    rows = matched(found.select("row", "doc_id", *IDENTITY, "node"), parted, "node", "copies").drop("node", "copies")
    rows = materialize(rows, "labelled")
    groups = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("lead"), F.count(F.lit(1)).alias("class_size"))
    out = matched(rows, groups, "part", "class_size")
    return out.select("doc_id", F.col("lead.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("lead.row")).alias("kept"), *IDENTITY)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays: that with the smallest doc_id."""
    return picked(docs, labelled(docs).filter("kept"))
