import math
import zlib
from collections import Counter

from weftline.llm import lattice as L


def total(own, word):
    """Sum over all segmentations, listed one by one."""
    text = own.START + word

    def ways(i):
        if i == len(text):
            return 1.0
        out = 0.0
        for j in range(i + 1, len(text) + 1):
            k = own.pieces.get(text[i:j])
            if k is not None:
                out += math.exp(own.log[k]) * ways(j)
        if text[i] not in own.pieces:
            out += math.exp(sum(own.log[own.bytes[b]] for b in text[i].encode())) * ways(i + 1)
        return out

    return ways(0)


def arrays(own, word):
    return next(own.grouped([word]))[1]


def test_forward_sums_all_segmentations():
    own = L.lattice(L.default_vocabulary())
    words = ["the", "station,", "größe", "x", "数据☃", "internationals", "", "zzqqzzqq", "▁a▁"]
    for word, got in zip(words, own.marginals(words), strict=True):
        assert math.isclose(got, math.log(total(own, word)), rel_tol=1e-9)


def test_expected_counts_by_finite_differences():
    """The expected count of a piece is the derivative of the log marginal by the log of its probability."""
    import numpy as np

    own = L.lattice(L.default_vocabulary())
    for word in ("nation", "größe☃", "aaaaaaaa"):
        into = np.zeros(own.prior.size)
        own.expect(arrays(own, word), np.array([3.0]), into)
        for i in np.flatnonzero(into > 1e-6):
            before = own.log[i]
            own.log[i] = before + 1e-5
            more = own.marginals([word])[0]
            own.log[i] = before - 1e-5
            less = own.marginals([word])[0]
            own.log[i] = before
            assert math.isclose(into[i], 3.0 * (more - less) / 2e-5, rel_tol=1e-4, abs_tol=1e-6)


def test_blocks_of_a_long_word_agree(monkeypatch):
    import numpy as np

    own = L.lattice(L.default_vocabulary())
    word = "internationalisierungsstation☃größe" * 40
    one, into = own.marginals([word])[0], np.zeros(own.prior.size)
    own.expect(arrays(own, word), np.array([1.0]), into)
    monkeypatch.setattr(L.Lattice, "BLOCK", 7)
    two, other = own.marginals([word])[0], np.zeros(own.prior.size)
    own.expect(arrays(own, word), np.array([1.0]), other)
    assert math.isclose(one, two, rel_tol=1e-12) and np.allclose(into, other)
    monkeypatch.undo()
    assert math.isfinite(own.marginals(["ab☃" * 20_000])[0])


def segmentations(own, text):
    if not text:
        yield ()
    for j in range(1, len(text) + 1):
        k = own.pieces.get(text[:j])
        if k is not None:
            for rest in segmentations(own, text[j:]):
                yield ((k,), *rest)
    if text and text[0] not in own.pieces:
        for rest in segmentations(own, text[1:]):
            yield (tuple(own.bytes[b] for b in text[0].encode()), *rest)


def refit(count, ends):
    """Expectation-maximisation over segmentations listed one by one."""
    import numpy as np

    own = L.lattice(L.default_vocabulary())
    p = own.prior
    for _ in range(L.ROUNDS):
        new = own.prior * 200.0
        for word, c in count.items():
            ways = [[k for ids in x for k in ids] for x in segmentations(own, own.START + word.decode())]
            weight = np.array([math.prod(p[k] for k in x) for x in ways])
            for x, y in zip(ways, c * weight / weight.sum(), strict=True):
                for k in x:
                    new[k] += y
        new[-1] += ends
        p = new / new.sum()
    return p


def test_against_brute_force(spark, make):
    docs = [(k, f"the cat sat on mat{k % 5} AND the Dog{k} ran\n fast") for k in range(60)] + [(60, None), (61, ""), (62, "zz\x0bqq é x")]
    count, ends = Counter(), 0
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    words = lambda t: (t or "").encode().lower().split()
    for i, t in docs:
        if not held(i):
            count.update(words(t))
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    got = {r.doc_id: r for r in L.score(make(docs)).collect()}
    p = refit(count, ends)
    own = L.lattice(L.default_vocabulary(), p)
    marginal = {w: math.log10(total(own, w.decode())) for w in {w for _, t in docs for w in words(t)}}
    for i, t in docs:
        w, r = words(t), got[i]
        assert math.isclose(r.score, sum(marginal[x] for x in w) + math.log10(p[-1]), rel_tol=1e-9)
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w) + 1, sum(x in count for x in w) + 1, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)


def test_head_and_join_agree(spark, make, monkeypatch):
    docs = make([(k, "a b c " * (k % 3) + f"d{k % 4} e") for k in range(40)])
    one = {r.doc_id: r for r in L.score(docs).collect()}
    monkeypatch.setattr(L, "HEAD", 1)
    two = {r.doc_id: r for r in L.score(docs).collect()}
    for k, r in one.items():
        assert math.isclose(r.score, two[k].score, rel_tol=1e-9) and math.isclose(r.base_score, two[k].base_score, rel_tol=1e-9) and r.n_known == two[k].n_known


def test_odd_and_empty(odd, make):
    assert L.score(odd).count() == odd.count()
    assert L.score(make([])).count() == 0


def test_plain_sums_agree_with_log_space(monkeypatch):
    """Words that are likely enough take no log space and find their arcs once; the others give the same either way."""
    import numpy as np

    own = L.lattice(L.default_vocabulary())
    words = ["the", "nation", "größe☃", "internationals", "数据☃☃☃☃☃", "x", "ab☃" * 60, "zzqq" * 9, "q" * 300]
    times, calls = np.arange(1.0, 1.0 + len(words)), []
    one = np.zeros(own.prior.size)
    found = L.Lattice.found
    monkeypatch.setattr(L.Lattice, "found", lambda self, text: calls.append(1) or found(self, text))
    for at, text in own.grouped(words[:6]):
        own.expect(text, times[at], one)
    assert len(calls) == len({len(w) for w in words[:6]})
    for at, text in own.grouped(words[6:]):
        own.expect(text, times[6 + at], one)
    plain = own.marginals(words)
    monkeypatch.setattr(L.Lattice, "FLOOR", 1.0)
    two = np.zeros(own.prior.size)
    for at, text in own.grouped(words):
        own.expect(text, times[at], two)
    assert np.allclose(one, two, rtol=1e-9, atol=1e-12) and np.allclose(plain, own.marginals(words), rtol=1e-12)


def test_gathered_batches_hold_all_rows():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"word": [b"w%d" % (10 * k + j) for j in range(10)], "c": list(range(10))}) for k in range(7)]
    got = list(L.gathered(iter(batches), rows=25))
    assert [b.num_rows for b in got] == [30, 30, 10] and pa.Table.from_batches(got).equals(pa.Table.from_batches(batches).combine_chunks())
