import hashlib
import re

from weftline.llm import exact_dedup as X


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    out = []
    for text, own in groups.items():
        keep = min(own, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))[0]
        staying = min(own, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        digest = hashlib.sha256(text.encode()).hexdigest()
        for k, r in enumerate(own):  # of rows that are alike one stays
            out.append((r[0], keep, len(own), r == staying and own.index(staying) == k, digest))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.drop("known").collect()], key=str)


def test_against_brute_force(spark, make):
    rows = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "c"), (5, None), (6, " "), (7, "A b"), (8, "a  b"), (8, "a  b"), (None, "c")]
    assert rows_of(X.dedup(make(rows), X.DigestIndex(spark, "ix_brute", 4))) == brute(rows)


def test_odd_and_empty(spark, odd, make):
    from tests.llm.conftest import ODD

    assert rows_of(X.dedup(odd, X.DigestIndex(spark, "ix_odd", 4))) == brute(ODD)
    assert X.dedup(make([]), X.DigestIndex(spark, "ix_none", 4)).count() == 0


def test_later_batches_meet_the_index(spark, make):
    index = X.DigestIndex(spark, "ix_batches", 4)
    X.dedup(make([(1, "a"), (2, "b")]), index)
    got = {r.doc_id: (r.keep_id, r.kept) for r in X.dedup(make([(3, " a "), (4, "c")]), index).collect()}
    assert got == {3: (1, False), 4: (4, True)}
    assert index.read().count() == 3


def test_a_batch_that_runs_again(spark, make):
    index = X.DigestIndex(spark, "ix_again", 4)
    X.dedup(make([(1, "a"), (2, "b")]), index, "first")
    one = rows_of(X.dedup(make([(3, " a "), (4, "c"), (5, "c")]), index, "second"))
    assert rows_of(X.dedup(make([(3, " a "), (4, "c"), (5, "c")]), index, "second")) == one
    assert [r[3] for r in one] == [False, True, False] and index.read().count() == 3


def test_large_groups_by_broadcast(spark, make, monkeypatch):
    monkeypatch.setattr("weftline.llm.common.HOT", 4)
    rows = [(k, "same") for k in range(30)] + [(k, f"own {k % 25}") for k in range(30, 70)]
    assert rows_of(X.dedup(make(rows), X.DigestIndex(spark, "ix_hot", 4))) == brute(rows)


def test_stage_keeps_one_row_of_a_group(spark, make):
    rows = [(4, "x"), (4, "x"), (4, "yy"), (3, "yy"), (5, "x"), (None, "z"), (None, "z"), (None, "w"), (6, None)]
    got = sorted([(r.doc_id, r.text) for r in X.stage(spark, make(rows), "").collect()], key=str)
    assert got == sorted([(4, "x"), (3, "yy"), (None, "z"), (None, "w"), (6, None)], key=str)


def test_the_index_is_joined_without_an_exchange(spark, make):
    index = X.DigestIndex(spark, "ix_join", 4)
    X.dedup(make([(k, f"t{k}") for k in range(50)]), index, "first")
    rows = X.grouped(X.digests(make([(k, f"t{k}") for k in range(40, 90)])))
    new = rows.join(index.others("second").select("text_sha256").hint("merge"), "text_sha256", "left_anti")
    assert new.count() == 40
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Bucketed: true" in plan.replace("SelectedBucketsCount", "Bucketed: true")
    tail = plan[plan.rindex("Exchange") :]
    assert "ix_join" not in tail or "Exchange" not in tail[1:]


def test_no_python_in_the_plan(spark, make):
    plan = X.dedup(make([(1, "a")]), X.DigestIndex(spark, "ix_plan", 4))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
