import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.llm import minhash as M
from weftline.llm import near_dedup as N


def sets_of(rows):
    out = []
    for _, t in rows:
        w = (t or "").lower().split()
        out.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(rows):
    found = sets_of(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = found[i], found[j]
            if a == b or (a and b and len(a & b) / len(a | b) >= 0.8):
                root[find(i)] = find(j)
    classes = {}
    for i, (d, _) in enumerate(rows):
        classes.setdefault(find(i), []).append(d)
    out = {}
    for own in classes.values():
        least = min([x for x in own if x is not None], default=None)
        for d in own:
            out.setdefault(d, set()).add((least, len(own)))
    return out


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"e{r.randrange(10**6)}"
    return " ".join(out)


def test_against_brute_force(spark, make):
    r = random.Random(9)
    rows, k = [], 0
    for _ in range(12):
        base = [f"w{r.randrange(5000)}" for _ in range(r.randint(30, 150))]
        for _ in range(r.randint(1, 14)):
            rows.append((k, edited(r, base, r.randint(0, 3))))
            k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, "one two"), (k + 3, "One  two"), (None, "one two"), (k + 4, "w " * 50), (k + 5, "w " * 80)]
    want = brute(rows)
    got = {}
    for x in N.classes(make(rows)).collect():
        got.setdefault(x.doc_id, set()).add((x.class_id, x.class_size))
        assert not x.kept or x.doc_id == x.class_id
    assert got == want


def test_chains_and_large_buckets_lose_no_link(spark, make):
    """A hub whose variants are near it but hardly near each other, and a chain: classes as by brute force."""
    r = random.Random(4)
    base = [f"b{k}" for k in range(200)]
    rows = [(k, edited(r, base, r.randint(1, 6))) for k in range(150)]
    chain = [f"c{k}" for k in range(120)]
    for k in range(150, 180):
        chain[r.randrange(120)] = f"n{k}"
        rows.append((k, " ".join(chain)))
    assert {d: s for d, s in brute(rows).items()} == {x.doc_id: {(x.class_id, x.class_size)} for x in N.classes(make(rows)).collect()}


def test_odd_and_empty(odd, make):
    got = N.classes(odd).collect()
    assert len(got) == odd.count()
    assert N.classes(make([])).count() == 0


def test_signature_estimates_probability_jaccard():
    r = np.random.default_rng(1)
    e = r.integers(1, 2**63, 400).astype(np.uint64)
    w = r.integers(1, 5, 400).astype(float)
    a, b = slice(0, 300), slice(100, 400)
    sig = M.signatures(np.concatenate([e[a], e[b]]), np.concatenate([w[a], w[b]]), np.array([0, 300, 600]), 4096)
    x, y = np.zeros(400), np.zeros(400)
    x[a], y[b] = w[a], w[b]
    both = (x > 0) & (y > 0)
    jp = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in np.flatnonzero(both))
    assert abs((sig[0] == sig[1]).mean() - jp) < 0.04


def test_copies_that_repeat_a_line_otherwise_often(spark, make):
    """The similarity is of sets, so how often a line is repeated must not cost a pair its candidates."""
    r = random.Random(3)
    rows = []
    for k in range(60):
        words = [f"p{r.randrange(10**6)}" for _ in range(300)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + words[-30:] * r.choice((50, 500))))]
    assert brute(rows) == {d: {(d - d % 2, 2)} for d, _ in rows}
    assert {x.doc_id: {(x.class_id, x.class_size)} for x in N.classes(make(rows)).collect()} == brute(rows)


def test_one_row_of_a_class_is_kept(spark, make, monkeypatch):
    """Also where doc_ids repeat or are null, and where classes and leaders are hot."""
    from weftline.llm import common

    monkeypatch.setattr(common, "HOT", 3)
    monkeypatch.setattr(N, "HOT", 3)
    r = random.Random(5)
    base = [f"b{k}" for k in range(100)]
    rows = [(k, " ".join(base)) for k in range(20)] + [(k, edited(r, base, 1)) for k in range(20, 50)] + [(7, "other text " * 9), (7, "other text " * 9), (7, "third"), (None, "third"), (None, "fourth"), (None, "fourth")]
    got = N.classes(make(rows)).collect()
    assert len(got) == len(rows)
    kept = {}
    for x in got:
        kept.setdefault((x.class_id, x.class_size), []).append(x.kept)
    assert {k: sum(v) for k, v in kept.items()} == {(0, 50): 1, (7, 2): 2, (None, 2): 1}
    left = sorted([(x.doc_id, x.text[:5]) for x in N.stage(spark, make(rows), "").collect()], key=str)
    assert left == [(0, "b0 b1"), (7, "other"), (7, "third"), (None, "fourt")]


def test_recall_of_near_pairs(spark, make):
    """Of pairs at 0.8 or more, all are in one class: thousands of pairs at similarities from 0.8 up, no two bases alike."""
    r = random.Random(12)
    rows, pairs = [], 0
    for k in range(600):
        words = [f"q{r.randrange(10**7)}" for _ in range(r.randint(40, 120))]
        other = edited(r, words, r.randint(0, 2)).split()
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    found = sets_of(rows)
    near = [k for k in range(600) if len(found[2 * k] & found[2 * k + 1]) >= 0.8 * len(found[2 * k] | found[2 * k + 1])]
    of = {x.doc_id: x.class_id for x in N.classes(make(rows)).collect()}
    assert len(near) > 300 and all(of[2 * k] == of[2 * k + 1] for k in near)


def test_joins_of_texts_and_sets_are_the_same_at_every_size(spark, make):
    """A table small enough to be sent to all tasks is shuffled like a large one, so that shuffles grow as the input does."""
    from weftline.llm.common import materialize

    r = random.Random(6)
    docs = make([(k, edited(r, [f"b{j}" for j in range(60)], 1)) for k in range(30)])
    nodes = materialize(N.sketches(docs), "sketches").select(*N.IDENTITY, "node")
    sets = materialize(N.sets_of(docs, nodes), "sets")
    pairs = sets.select(F.col("node").alias("a"), F.min("node").over(Window.partitionBy(F.lit(1))).alias("b")).filter("a <> b")
    for found in (N.sets_of(docs, nodes), N.verified(pairs, sets)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("strategy=merge") == plan.count("Join Inner") + plan.count("Join LeftSemi") > 0
    docs = materialize(docs, "docs")
    plan = N.sets_of(docs, nodes)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
