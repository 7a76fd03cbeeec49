import random

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import quality as Q
from weftline.llm import toxicity as X


def corpus(n=700, seed=5):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(20, 200))]
        bad, toxic = r.random() < 0.3, r.random() < 0.3
        if toxic:
            text.insert(r.randrange(len(text)), r.choice(["vile", "nasty!"]))
        if bad:
            text = [w + r.choice(["###", "$$$"]) for w in text]
        docs.append((i, " ".join(text)))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def accuracy(df, labels, column):
    want = {r[0]: r[column] for r in labels}
    got = [(r.predicted, want[r.doc_id]) for r in df.filter("held_out").collect()]
    return np.mean([a == b for a, b in got])


def test_held_out_accuracy(spark, make):
    docs, labels = corpus()
    table = spark.createDataFrame(labels + [(1, None, None), (None, 1, 1), (10**6, 1, 0)], "doc_id long, quality int, toxic int")
    df = make(docs)
    assert accuracy(Q.score(df, Q.fit(df, table)), labels, 1) > 0.95
    scored = X.score(df, X.fit(df, table)).cache()
    assert accuracy(scored, labels, 2) > 0.95
    fold = {r.doc_id: r.held_out for r in scored.collect()}
    want = {r[0]: r[1] for r in df.select("doc_id", F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")).collect()}
    assert fold == want


def test_labels_of_the_held_out_fold_are_never_read(spark, make):
    docs, labels = corpus(120)
    df = make(docs)
    names = "doc_id long, quality int, toxic int"
    held = {r.doc_id for r in df.filter(X.in_fold(F.col("doc_id"), 5, 0)).collect()}
    turned = [(i, 1 - q if i in held else q, 1 - t if i in held else t) for i, q, t in labels]
    for module in (Q, X):
        a, b = (module.score(df, module.fit(df, spark.createDataFrame(x, names))).select("doc_id", "score").orderBy("doc_id").collect() for x in (labels, turned))
        assert a == b


def test_odd_rows_and_no_labels(spark, odd, make):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(4, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    for module in (Q, X):
        for labels in (none, some):
            got = module.score(odd, module.fit(odd, labels)).collect()
            assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
        assert module.score(make([]), module.fit(odd, none)).count() == 0
    assert set(Q.keep(odd, Q.fit(odd, none)).columns) == set(odd.columns)


def test_features_by_hand():
    from weftline.llm.common import AT_SYMBOL, hashed_words

    texts = [b"a b c", b"", b"a b", b"a"]
    (_, _, h, o), *_ = hashed_words(texts, AT_SYMBOL)
    sizes = [X.features_of(h[o[i] : o[i + 1]]).size for i in range(4)]
    assert sizes == [6, 0, 3, 1]  # words, pairs, skip pairs


def test_attention_sums_to_one(spark, make):
    docs, labels = corpus(60)
    df = make(docs)
    model = Q.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    for r in Q.score(df, model, with_passages=True).collect():
        assert abs(sum(r.weights) - 1) < 1e-6


def small_model(seed=3, hidden=5, gate=4):
    r = np.random.default_rng(seed)
    n = Q.N_FEATURES
    p = {"mean": r.normal(0, 0.1, n), "scale": r.uniform(0.5, 2, n), "W": r.normal(0, 0.3, (n, hidden)), "b": r.normal(0, 0.1, hidden), "V": r.normal(0, 1, (hidden, gate)), "U": r.normal(0, 1, (hidden, gate)), "w": r.normal(0, 1, gate), "c": r.normal(0, 1, hidden), "d": np.array(0.2)}
    return Q.Model(p), r


def test_attention_by_loops():
    model, r = small_model()
    p, bags = model.p, [r.uniform(0, 1, (k, Q.N_FEATURES)) for k in (1, 4, 2)]
    got, weights, _ = model.attend(np.concatenate(bags), np.array([0, 1, 5]))
    want = []
    for bag in bags:
        hs, es = [], []
        for x in bag:
            h = [np.tanh(sum((x[f] - p["mean"][f]) * p["scale"][f] * p["W"][f, j] for f in range(x.size)) + p["b"][j]) for j in range(5)]
            gate = [np.tanh(sum(h[j] * p["V"][j, g] for j in range(5))) / (1 + np.exp(-sum(h[j] * p["U"][j, g] for j in range(5)))) for g in range(4)]
            hs.append(h)
            es.append(np.exp(sum(gate[g] * p["w"][g] for g in range(4))))
        own = [e / sum(es) for e in es]
        want.append(own)
        z = [sum(a * h[j] for a, h in zip(own, hs, strict=True)) for j in range(5)]
        assert abs(got[len(want) - 1] - 1 / (1 + np.exp(-(sum(z[j] * p["c"][j] for j in range(5)) + p["d"])))) < 1e-9
    assert np.allclose(weights, np.concatenate(want))


def test_gradients_by_finite_differences():
    model, r = small_model(4)
    x, first, labels = r.uniform(0, 1, (9, Q.N_FEATURES)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        y = model.attend(x, first)[0]
        return -np.mean(labels * np.log(y) + (1 - labels) * np.log(1 - y))

    for name, g in Q.gradients(model, x, first, labels).items():
        flat = model.p[name].reshape(-1)
        for k in r.choice(flat.size, min(flat.size, 12), replace=False):
            before = flat[k]
            flat[k] = before + 1e-6
            more = loss()
            flat[k] = before - 1e-6
            less = loss()
            flat[k] = before
            assert abs(np.reshape(g, -1)[k] - (more - less) / 2e-6) < 1e-6


def test_ftrl_by_the_definition():
    r = np.random.default_rng(6)
    rows = [np.unique(r.integers(0, 40, r.integers(0, 12))).astype(np.uint32) for _ in range(80)]
    labels = np.array([float(5 in x or 7 in x) for x in rows])
    alpha, beta, l1, l2, epochs = 2.0, 1.0, 1.5, 0.1, 3
    z, n, zb, nb = {}, {}, 0.0, 0.0
    prior = np.log(labels.mean() / (1 - labels.mean()))

    def weight(f):
        if abs(z.get(f, 0.0)) <= l1:
            return 0.0
        return -(z[f] - np.sign(z[f]) * l1) / ((beta + n[f] ** 0.5) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            w = {f: weight(f) for f in rows[i].tolist()}
            bias = prior - zb / ((beta + nb**0.5) / alpha)
            g = 1 / (1 + np.exp(-(sum(w.values()) + bias))) - labels[i]
            for f in w:
                z[f] = z.get(f, 0.0) + g - ((n.get(f, 0.0) + g * g) ** 0.5 - n.get(f, 0.0) ** 0.5) / alpha * w[f]
                n[f] = n.get(f, 0.0) + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * (bias - prior)
            nb += g * g
    model = X.ftrl(rows, labels, alpha, beta, l1, l2, epochs)
    want = {f: weight(f) for f in z if weight(f)}
    assert model.features.tolist() == sorted(want) and np.allclose(model.weights, [want[f] for f in sorted(want)])
    assert 0 < len(want) < 40 and abs(model.bias - (prior - zb / ((beta + nb**0.5) / alpha))) < 1e-9


def test_scores_by_loops(spark, make):
    from weftline.llm.common import AT_SYMBOL, hashed_words

    docs, labels = corpus(80)
    docs += [(900, None), (901, ""), (902, "vile"), (903, "a")]
    df = make(docs)
    model = X.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    table = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    got = {r.doc_id: r.score for r in X.score(df, model).collect()}
    for i, t in docs:
        ((_, _, h, o),) = hashed_words([(t or "").lower().encode()], AT_SYMBOL)
        total = model.bias + sum(table.get(f, 0.0) for f in set(X.features_of(h[o[0] : o[1]]).tolist()))
        assert abs(got[i] - 1 / (1 + np.exp(-total))) < 1e-9


def test_the_sample_is_bounded(spark, make):
    docs = make([(k, "x" * 100) for k in range(60)] + [(3, "x" * 100)] * 5 + [(70, None)])
    labels = spark.createDataFrame([(k, 1, 1) for k in range(71)], "doc_id long, quality int, toxic int")
    got = X.labelled_sample(docs, labels, "toxic", 1000, 1500).collect()
    assert len({r.doc_id for r in got}) == len(got) and 14 <= len(got) <= 17
    assert len(X.labelled_sample(docs, labels, "toxic", 7, 10**9).collect()) <= 7
