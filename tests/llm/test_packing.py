import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from weftline.llm import packing as P


def check(histogram, capacity=P.CAPACITY, **more):
    rows, total = P.plan(dict(histogram), capacity, **more)
    used, placed, spans = Counter(), defaultdict(list), defaultdict(list)
    for length, first, n, sequence, offset in rows:
        placed[length].append((first, n))
        for i in range(n):
            spans[sequence + i].append((offset, length))
            used[sequence + i] += length
    for length, n in histogram.items():
        assert sorted(x for f, k in placed[length] for x in range(f, f + k)) == list(range(n))
    assert sorted(used) == list(range(total)) and max(used.values(), default=0) <= capacity
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
    return total


def test_plan_is_whole_and_tight():
    r = random.Random(3)
    for n, top in ((0, 10), (1, 1024), (500, 1024), (20_000, 1024), (3000, 60)):
        h = Counter(r.randint(1, top) for _ in range(n))
        bound = -(-sum(k * c for k, c in h.items()) // 1024)
        assert check(h) <= bound * 1.01 + 20
    assert check({1024: 7}) == 7
    assert check({512: 5}) == 3
    assert check({600: 1000, 424: 1000}) == 1000
    check(Counter(r.randint(1, 1024) for _ in range(2000)), groups=16)


def test_ids_are_the_tokenizers():
    t = Tokenizer.from_file(P.default_tokenizer())
    t.encode_special_tokens = True
    encode = P.encoder(P.default_tokenizer())
    for x in ["", " ", "  a  b ", "it's\n\n x\t", "Größe ésprit 数据 🙂", "<|endoftext|>", "a" * 3000, "12 345", " " * 1_500_000, "a" + "\n " * 800_000 + "b", "é" * 200_000]:
        assert encode(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()


def test_pieces_and_places(spark, odd, make):
    t = Tokenizer.from_file(P.default_tokenizer())
    from tests.llm.conftest import ODD

    got = P.pack(P.pieces(odd)).collect()
    want = []
    for i, x in ODD:
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        for k, (start, length) in enumerate(P.cut(len(ids), 1024)):
            want.append((i, k, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())))
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert P.pack(P.pieces(make([]))).count() == 0


def test_ids_of_the_small_tables(spark):
    """Every text of the smallest table has the ids of `tokenizers`."""
    t = Tokenizer.from_file(P.default_tokenizer())
    t.encode_special_tokens = True
    encode = P.encoder(P.default_tokenizer())
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for x, own in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(x) == np.array(own.ids, "<u4").tobytes()


def optimum(lengths, capacity):
    """The fewest sequences, by trying every place for each length."""
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        seen = set()
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity and bins[k] not in seen:
                seen.add(bins[k])
                bins[k] += lengths[i]
                go(i + 1, bins)
                bins[k] -= lengths[i]
        bins.append(lengths[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def test_small_cases_against_the_optimum():
    r = random.Random(8)
    for _ in range(60):
        lengths = sorted((r.randint(1, 20) for _ in range(r.randint(1, 9))), reverse=True)
        best = optimum(lengths, 20)
        assert best <= check(Counter(lengths), 20) <= best + 1
