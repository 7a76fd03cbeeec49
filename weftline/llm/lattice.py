"""Language-model scoring by subword lattices.

The pieces of an existing tokenizer's vocabulary span a lattice over every word, led by the word-start mark, and no piece reaches
over it, so the lattice of a text is the row of its words' lattices and the end. A forward recursion in log space sums over all
segmentations; a text's score is the log probability of all of them together:

    score(text) = sum over words of log10 M(word) + log10 p(end),    M(word) = sum over segmentations of the product of p(piece)

The pieces and the end share one distribution. It starts from the vocabulary's own scores and is re-estimated by ROUNDS of
expectation-maximisation over every training word with its count, so all training documents weigh in. A vocabulary whose scores only
rank its pieces (as a BPE's do) starts from a Zipf law over the ranks.

Words are counted over all documents, so the tables grow with the corpus. Words with at least N / HEAD occurrences, of which
there can be HEAD at most, are looked up where the text is read; the rest are joined by word. No word of the join can be
frequent, so no partition is hot.

The recursion runs over many words of one length at once, as arrays of plain probabilities; words too unlikely for that go through in
log space, and a very long one in blocks of places, so memory follows the block and a word may have any length.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, in_fold, materialize, mix, ship, table, utf8

FOLDS, HELD_OUT = 7, 2
HEAD = 400_000
ROUNDS = 3
#: Words that a task counts before it passes them on.
FLUSH = 300_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    """Pieces and their log probabilities. A word is led by the word-start mark; a character that is no piece is spelled in bytes.

    `log` has a value per piece of the vocabulary and, at its end, the end of the text.
    """

    START = "▁"
    #: Places of a lattice that are held at once.
    BLOCK = 1 << 15
    #: Natural log of the least probability that is summed outside log space.
    FLOOR = -600.0

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, int] = {}
        self.bytes = {}
        scores = np.zeros(model.get_piece_size())
        for i in range(scores.size):
            piece = model.id_to_piece(i)
            scores[i] = model.get_score(i)
            if model.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and self.START not in piece[1:] and not any("A" <= c <= "Z" for c in piece):
                self.pieces[piece] = i
        used = sorted(self.pieces.values())
        weight = np.zeros(scores.size + 1)
        if scores[used].min() < -1000:  # scores that only give the rank of a piece: a Zipf law
            weight[used] = 1 / (10 + np.argsort(np.argsort(-scores[used], kind="stable"), kind="stable"))
        else:
            weight[used] = np.exp(scores[used] - scores[used].max())
        spelled = list(self.bytes.values())
        weight[spelled] = 0.001 * weight.sum() / max(1, len(spelled))
        weight[-1] = 0.001 * weight.sum()
        self.prior = weight / weight.sum()
        self.log = self.logs(self.prior)
        self.longest = max(map(len, self.pieces))
        # pieces by the hash of their characters, and a table of bits that drops nearly all other strings before the search
        keys = np.array([self.hashed(np.array([[*map(ord, x)]], np.uint64))[-1][0, 0] for x in self.pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(list(self.pieces.values()), np.int32)[order]
        if np.unique(keys).size < keys.size:
            raise ValueError("two pieces share a hash")
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.keys >> np.uint64(42)] = True

    @staticmethod
    def logs(p: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(p, 1e-30))

    @staticmethod
    def hashed(text: np.ndarray, most: int | None = None) -> list[np.ndarray]:
        """For each length the hashes of the runs of that many characters (words by places)."""
        out, value = [], np.zeros_like(text)
        for size in range(1, min(most or text.shape[1], text.shape[1]) + 1):
            many = text.shape[1] - size + 1
            value = value[:, :many] * np.uint64(0x9E3779B97F4A7C15) + text[:, size - 1 :] + np.uint64(1)
            out.append(mix(value))
        return out

    def found(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece (or -1) of every arc: word, place where it starts, length less one; and log probabilities of single characters. Spelled characters have -2."""
        words, n = text.shape
        wide = min(n, self.longest)
        piece = np.full((words, n, wide), -1, np.int32)
        for k, key in enumerate(self.hashed(text, wide)):
            w, i = np.nonzero(self.bits[key >> np.uint64(42)])
            found = key[w, i]
            at = np.minimum(np.searchsorted(self.keys, found), self.keys.size - 1)
            real = self.keys[at] == found
            piece[w[real], i[real], k] = self.ids[at[real]]
        single = self.log[piece[:, :, 0]]
        w, i = np.nonzero(piece[:, :, 0] < 0)
        if w.size:
            chars, back = np.unique(text[w, i], return_inverse=True)
            single[w, i] = np.array([sum(self.log[self.bytes[b]] for b in chr(c).encode()) for c in chars.tolist()])[back]
            piece[w, i, 0] = -2
        return piece, single

    def arcs(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece (or -1) and log probability of every arc, as in `found`."""
        piece, single = self.found(text)
        logp = np.where(piece >= 0, self.log[piece], -np.inf)
        logp[:, :, 0] = single
        return piece, logp

    def split(self, text: np.ndarray):
        """Places of the words that need log space (any word whose characters, one by one, are less likely than exp(FLOOR)), then those that do not, with their arcs.

        Every place of the others is reached with at least that probability, so plain sums of products stay within doubles.
        """
        if text.shape[1] > self.BLOCK:
            return np.arange(text.shape[0]), None, None, None
        piece, single = self.found(text)
        plain = single.sum(1) > self.FLOOR
        if plain.all():
            return np.zeros(0, np.int64), np.arange(text.shape[0]), piece, single
        return np.flatnonzero(~plain), np.flatnonzero(plain), piece[plain], single[plain]

    def plain(self, piece: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Summed probability of all ways to reach each place (places and one by words), and the probabilities of arcs: place where they end, length less one, word."""
        words, n, wide = piece.shape
        p = np.append(np.exp(self.log), 0.0)
        arc = np.zeros((n + 1, wide, words))
        arc[1:, 0] = np.exp(single).T
        for k in range(1, wide):
            arc[k + 1 :, k] = p[piece[:, : n - k, k].T]
        a = np.zeros((n + 1, words))
        a[0] = 1
        for j in range(1, n + 1):
            k = min(j, wide)
            a[j] = (a[j - k : j] * arc[j, :k][::-1]).sum(0)
        return a, arc

    def forward(self, text: np.ndarray) -> np.ndarray:
        """log of the summed probability of all ways to reach each place (words by places and one)."""
        words, n = text.shape
        a = np.zeros((words, n + 1))
        for lo in range(0, n, self.BLOCK):
            hi = min(n, lo + self.BLOCK)
            before = max(0, lo - self.longest + 1)  # arcs from there reach into this block
            _, logp = self.arcs(text[:, before : min(n, hi + self.longest)])
            wide = logp.shape[2]
            for j in range(lo + 1, hi + 1):
                many = min(j, wide)
                into = np.stack([a[:, j - k] + logp[:, j - k - before, k - 1] for k in range(1, many + 1)])
                top = into.max(0)
                a[:, j] = top + np.log(np.exp(into - top).sum(0))
        return a

    def expect(self, text: np.ndarray, times: np.ndarray, into: np.ndarray) -> None:
        """Adds the expected counts of pieces of words that occur `times`."""
        rest, own, piece, single = self.split(text)
        if rest.size:
            self.expect_logs(text[rest], times[rest], into)
        if own is None or not own.size:
            return
        words, n, wide = piece.shape
        a, arc = self.plain(piece, single)
        share = np.zeros((n + 1, words))  # expected number of segmentations that pass a place
        share[n] = times[own]
        for j in range(n, 0, -1):
            k = min(j, wide)
            x = a[j - k : j] * arc[j, :k][::-1] * (share[j] / a[j])
            share[j - k : j] += x
            arc[j, :k] = x[::-1]
        ids, passed = [], []
        for k in range(wide):
            part = piece[:, : n - k, k].T
            real = part >= 0
            ids.append(part[real])
            passed.append(arc[k + 1 :, k][real])
        into += np.bincount(np.concatenate(ids), np.concatenate(passed), into.size)
        w, i = np.nonzero(piece[:, :, 0] == -2)
        if w.size:
            chars, back = np.unique(text[own[w], i], return_inverse=True)
            for c, x in zip(chars.tolist(), np.bincount(back, arc[i + 1, 0, w]).tolist(), strict=True):
                for b in chr(c).encode():
                    into[self.bytes[b]] += x

    def expect_logs(self, text: np.ndarray, times: np.ndarray, into: np.ndarray) -> None:
        """`expect` in log space and in blocks of places, for words of any length."""
        words, n = text.shape
        a = self.forward(text)
        share = np.zeros((words, n + 1))  # expected number of segmentations that pass a place
        share[:, n] = times
        for hi in range(n, 0, -self.BLOCK):
            lo = max(0, hi - self.BLOCK)
            before = max(0, lo - self.longest + 1)
            part = text[:, before : min(n, hi + self.longest)]
            piece, logp = self.arcs(part)
            passed = np.zeros_like(logp)
            for j in range(hi, lo, -1):
                for k in range(1, min(j, logp.shape[2]) + 1):
                    i = j - k
                    x = share[:, j] * np.exp(a[:, i] + logp[:, i - before, k - 1] - a[:, j])
                    share[:, i] += x
                    passed[:, i - before, k - 1] = x
            real = piece >= 0
            into += np.bincount(piece[real], passed[real], into.size)
            w, i = np.nonzero(piece[:, :, 0] == -2)
            for c, x in zip(part[w, i].tolist(), passed[w, i, 0].tolist(), strict=True):
                for b in chr(c).encode():
                    into[self.bytes[b]] += x

    def grouped(self, words: list[str], cells: int = 1 << 17):
        """(places in `words`, their characters as an array) of words of one length, about `cells` characters at once."""
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(size, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
            if not own.size:
                continue
            n = int(size[own[0]])
            step = max(1, cells // (n * min(n, self.longest)))
            for lo in range(0, own.size, step):
                part = own[lo : lo + step]
                data = "".join(self.START + words[k] for k in part.tolist()).encode("utf-32-le", "surrogatepass")
                yield part, np.frombuffer(data, "<u4").reshape(part.size, n).astype(np.uint64)

    def marginals(self, words: list[str]) -> np.ndarray:
        """Natural log of M(word) of each word."""
        out = np.zeros(len(words))
        for own, text in self.grouped(words):
            rest, easy, piece, single = self.split(text)
            if rest.size:
                out[own[rest]] = self.forward(text[rest])[:, -1]
            if easy is not None and easy.size:
                out[own[easy]] = np.log(self.plain(piece, single)[0][-1])
        return out


_LATTICES: dict[str, Lattice] = {}


def lattice(path: str, p: np.ndarray | None = None) -> Lattice:
    """One lattice per worker process and vocabulary, with the given piece probabilities."""
    if path not in _LATTICES:
        _LATTICES[path] = Lattice(path)
    out = _LATTICES[path]
    out.log = out.logs(out.prior if p is None else p)
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """word (bytes), c (occurrences in training documents) of every word of all documents."""
    ship(docs.sparkSession)

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        seen, learned = Counter(), Counter()

        def out():
            words = list(seen)
            got = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([learned[w] for w in words], pa.int64())], names=["word", "c"])
            seen.clear()
            learned.clear()
            return got

        for whole in batches:
            for batch in chunks(whole):
                for text, train in zip(utf8(batch.column(0).to_pylist()), batch.column(1).to_pylist(), strict=True):
                    words = text.lower().split()
                    if train:
                        learned.update(words)
                        seen.update(dict.fromkeys(words, 1))
                    else:
                        seen.update(dict.fromkeys(words, 1))
                if len(seen) > FLUSH:
                    yield out()
        yield out()

    rows = docs.select("text", (~in_fold(F.col("doc_id"), FOLDS, HELD_OUT)).alias("train")).mapInArrow(run, "word binary, c long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"))


def gathered(batches, rows: int = 1 << 16, limit: int = 16 << 20):
    """The batches in larger ones of about `rows` rows or `limit` bytes: words of one length go through together, so more of them cost hardly more."""
    import pyarrow as pa

    held, n, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n >= rows or size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n, size = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def fit(words: DataFrame, path: str, ends: int, rounds: int = ROUNDS, prior_mass: float = 200.0) -> np.ndarray:
    """Probabilities of pieces and the end after `rounds` of expectation-maximisation; only sums per piece reach the driver."""
    p = lattice(path).prior
    rows = words.filter("c > 0")
    for _ in range(rounds):

        def run(batches, p=p):
            import pyarrow as pa

            own = lattice(path, p)
            total = np.zeros(p.size)
            for batch in gathered(batches):
                found = [x.decode("utf-8", "replace") for x in batch.column(0).to_pylist()]
                times = batch.column(1).to_numpy().astype(float)
                for at, text in own.grouped(found):
                    own.expect(text, times[at], total)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["piece", "x"])

        got = rows.mapInArrow(run, "piece int, x double").groupBy("piece").agg(F.sum("x").alias("x")).collect()
        total = lattice(path).prior * prior_mass
        for r in sorted(got):
            total[r["piece"]] += r["x"]
        total[-1] += ends
        p = total / total.sum()
    return p


def word_scores(words: DataFrame, path: str, p: np.ndarray) -> DataFrame:
    """word, c, lp: log10 M(word) of every word."""

    def run(batches):
        import pyarrow as pa

        own = lattice(path, p)
        for batch in gathered(batches):
            found = own.marginals([x.decode("utf-8", "replace") for x in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found / math.log(10))], names=["word", "c", "lp"])

    return words.mapInArrow(run, "word binary, c long, lp double")


def score(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from the rows outside the held-out fold. Null text is empty: its only token is the end. Repeated rows are scored each
    on its own. Without training rows the pieces' own scores are all there is. Other columns are not read.
    """
    path = path or default_vocabulary()
    spark = docs.sparkSession
    words = materialize(word_counts(docs), "words")
    ends = docs.filter(~in_fold(F.col("doc_id"), FOLDS, HELD_OUT)).count()
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    n, v = total[0] + ends, total[1] + (ends > 0)
    p = fit(words, path, ends)
    scored = materialize(word_scores(words, path, p), "word-scores")
    base_of = lambda c: math.log10((c + 1) / (n + v + 1))
    end = (math.log10(p[-1]), base_of(ends))
    least = max(1, -(-n // HEAD))
    head = spark.sparkContext.broadcast({bytes(r["word"]): (r["c"], r["lp"]) for r in scored.filter(F.col("c") >= least).toLocalIterator()})  # HEAD words at most

    key = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("row", T.LongType()), T.StructField("word", T.BinaryType()), T.StructField("tf", T.LongType()), T.StructField("doc_id", key), T.StructField("held_out", T.BooleanType())]
        + [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("lp", T.DoubleType())]
    )

    def run(batches):
        from collections import Counter

        import pyarrow as pa
        from pyspark import TaskContext

        known = head.value
        bases: dict[int, float] = {}
        row = TaskContext.get().partitionId() << 36
        kinds = [pa.int64(), pa.binary(), pa.int64(), None, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        for whole in batches:
            kinds[3] = whole.schema.field(0).type
            for batch in chunks(whole, 1 << 20):
                rows: list[tuple] = []
                for doc_id, text, held in zip(batch.column(0).to_pylist(), utf8(batch.column(1).to_pylist()), batch.column(2).to_pylist(), strict=True):
                    row += 1
                    words = text.lower().split()
                    lp, base, found = end[0], end[1], int(ends > 0)
                    for word, tf in Counter(words).items():
                        hit = known.get(word)
                        if hit is None:
                            rows.append((row, word, tf, None, None, None, None, None, None))
                        else:
                            c = hit[0]
                            if c not in bases:
                                bases[c] = base_of(c)
                            lp += tf * hit[1]
                            base += tf * bases[c]
                            found += tf
                    rows.append((row, b" %d" % row, 0, doc_id, held, len(words) + 1, found, base, lp))  # no word holds a space
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

    rows = docs.select("doc_id", "text", in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out")).mapInArrow(run, schema)
    rare = scored.filter(F.col("c") < least).select("word", F.col("c").alias("wc"), F.col("lp").alias("wlp"))
    joined = rows.join(rare, "word", "left")
    joined = joined.select(
        "row", "doc_id", "held_out", "n_tokens",
        F.coalesce("n_known", F.when(F.col("wc") > 0, F.col("tf")), F.lit(0)).alias("k"),
        F.coalesce("base", F.col("tf") * F.log10((F.col("wc") + 1) / F.lit(float(n + v + 1)))).alias("b"),
        F.coalesce("lp", F.col("tf") * F.col("wlp")).alias("s"),
    )
    out = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("k").alias("n_known"), F.sum("b").alias("base_score"), F.sum("s").alias("score"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
