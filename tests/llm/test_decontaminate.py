import random

import numpy as np

from weftline.llm import decontaminate as D
from weftline.llm import tiling


def greedy(p, t, least):
    """Greedy string tiling by definition."""
    fp, ft, out = [True] * len(p), [True] * len(t), []
    while True:
        best, found = least, []
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and fp[i + n] and ft[j + n] and p[i + n] == t[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best:
                    found.append((i, j))
        if not found:
            return out
        for i, j in found:
            if all(fp[i : i + best]) and all(ft[j : j + best]):
                fp[i : i + best] = ft[j : j + best] = [False] * best
                out.append((i, j, best))


def test_tiles_against_definition():
    r = random.Random(2)
    for _ in range(300):
        kinds = r.choice((2, 3, 4, 6))
        p = np.array([r.randrange(kinds) for _ in range(r.randint(3, 30))], np.uint64)
        t = np.array([r.randrange(kinds) for _ in range(r.randint(3, 60))], np.uint64)
        got = tiling.tiles(p, t, 3)
        assert got == greedy(p.tolist(), t.tolist(), 3)
        for i, j, n in got:
            assert p[i : i + n].tolist() == t[j : j + n].tolist() and n >= 3
        assert len({x for i, _, n in got for x in range(i, i + n)}) == sum(n for *_, n in got)


def test_planted_passages(spark, make):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(40))) for k in range(20)] + [(20, None), (21, ""), (22, "short item")]
    plain = lambda n: " ".join(word() for _ in range(n))
    docs, want = [], set()
    for k in range(20):
        w = items[k][1].split()
        docs.append((k, plain(100) + " " + ", ".join(w).upper() + " " + plain(50)))
        docs.append((100 + k, plain(9) + " " + " ".join(w[20:]) + " " + plain(9) + " " + " ".join(w[:20])))  # parts moved
        docs.append((200 + k, plain(60) + " " + " ".join(w[:12]) + " " + plain(60)))  # too little
        want |= {(k, k), (100 + k, k)}
    docs += [(300, "a Short, item."), (301, None), (302, ""), (None, plain(5))]
    want.add((300, 22))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in D.contaminated(make(docs), bench).collect()}
    assert got == want
    kept = {x.doc_id for x in D.clean(make(docs), bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_blocks_change_nothing(spark, make, monkeypatch):
    items = [(k, " ".join(f"q{k}x{j}" for j in range(12))) for k in range(9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make([(k, "pre " + t + " post") for k, t in items])
    whole = sorted(map(tuple, D.contaminated(docs, bench).collect()))
    small = D.blocks
    monkeypatch.setattr(D, "blocks", lambda b: small(b, 30))
    assert sorted(map(tuple, D.contaminated(docs, bench).collect())) == whole and len(whole) == 9


def test_odd_and_empty(spark, odd, make):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(odd, none).count() == 0 and D.clean(odd, none).count() == odd.count()
    assert D.contaminated(make([]), none).count() == 0


def test_texts_of_few_words_are_tiled_in_bounded_time():
    import time

    began = time.time()
    one = np.full(400, 7, np.uint64)
    assert tiling.tiles(one, np.full(40_000, 7, np.uint64), 5) == [(0, 0, 400)]
    two = np.tile(np.array([1, 2], np.uint64), 200)
    assert sum(n for *_, n in tiling.tiles(two, np.tile(np.array([2, 1, 1], np.uint64), 5000), 2)) == 300  # runs 1 2 1, and the 2 between them is left
    assert time.time() - began < 20
