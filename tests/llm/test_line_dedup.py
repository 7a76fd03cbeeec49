import random

from weftline.llm import line_dedup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs):
    lines = sorted(((i is None, i or 0, k), i, k, [w for w in x.lower().split() if w]) for i, t in docs for k, x in enumerate((t or "").split("\n")))
    out = []
    for ref, i, k, w in lines:
        keep = (i, k)
        for other, oi, ok, ow in lines:
            if other > ref:
                break
            if w and (w == ow or (len(w) >= 8 and len(ow) >= 8 and distance(w, ow) <= 1)):
                keep = (oi, ok)
                break
        out.append((i, k, *keep, keep == (i, k)))
    return sorted(out, key=str)


def make_docs(seed=1):
    r = random.Random(seed)
    base = [[f"w{r.randrange(40)}" for _ in range(r.randint(1, 14))] for _ in range(12)]
    docs = []
    for d in range(40):
        lines = []
        for _ in range(r.randint(1, 5)):
            w = list(r.choice(base))
            for _ in range(r.randint(0, 2)):
                at = r.randrange(len(w) + 1)
                kind = r.randrange(3)
                if kind == 0:
                    w.insert(at, f"n{r.randrange(9)}")
                elif w and at < len(w):
                    w[at : at + 1] = [] if kind == 1 else [f"n{r.randrange(9)}"]
            lines.append(" ".join(w))
        docs.append((d, "\n".join(lines)))
    return docs


def test_against_brute_force(make):
    for seed in (1, 2):
        docs = make_docs(seed) + [(100, None), (101, "\n \n"), (None, "w1 w2"), (102, "A  b\tc d e f g h"), (103, "a b c d e f g h\na b c d e f g h")]
        got = sorted([tuple(r) for r in L.dedup(make(docs)).collect()], key=str)
        assert got == brute(docs)


def test_text_without_dropped_lines(make):
    docs = make([(1, "one two\nthree"), (2, "one two\n\nfour"), (3, "three")])
    got = {r.doc_id: r.text for r in L.without_dropped(docs, L.dedup(docs)).collect()}
    assert got == {1: "one two\nthree", 2: "\nfour", 3: ""}


def test_odd_empty_and_native(odd, make):
    out = L.dedup(odd)
    assert out.count() > 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert L.dedup(make([])).count() == 0


def test_variants_are_made_once(make):
    """One explode and one shuffle of the deletion neighbourhood, however many steps use it."""
    plan = L.dedup(make(make_docs()))._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Generate explode(" in x and "sequence(" in x for x in plan.split("\n")) == 1
