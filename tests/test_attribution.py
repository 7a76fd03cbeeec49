"""Roles of measured colours and answers of a model, against hand-made cases and plain loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import answers as A
from weftline.operators import attribution as R

NODES = "capture_id int, ord int, colors array<struct<channel:string,value:string>>, states array<struct<state:string,changes:array<struct<property:string,from:string,to:string>>>>"
PALETTE = "capture_id int, ord int, role string, hex string"


@pytest.fixture(scope="module")
def palette(spark):
    return spark.createDataFrame([(1, 0, "background", "#ffffff"), (1, 1, None, "#2050c0"), (1, 2, "primary", "#2050c1"), (2, 0, "primary", "#ffff00"), (None, 0, "primary", "#000000")], PALETTE)


@pytest.fixture(scope="module")
def nodes(spark):
    def hover(*changes):
        return [("hover", list(changes))]

    blue, white = ("background", "rgb(32, 80, 192)"), ("text", "#FFF")
    return spark.createDataFrame(
        [
            (1, 0, [blue, white], hover(("background-color", "#2050C0", "rgb(1, 2, 3)"), ("box-shadow", "none", "0 1px"))),
            (1, 1, [blue, ("text", "#eee")], hover(("background-color", "#2050C0", "#000")) + [("focus", [])]),
            (1, 2, [blue, ("text", "#EEEEEE")], hover(("background-color", "#2050C0", "#000"), ("color", "inherit", "#fff"))),
            (1, 3, [("border", "#fefefe")], [("active", [("color", "#000", "#111")])]),
            (1, 4, [("background", "#808000")], hover(("color", "a", "b"))),
            (1, 5, None, hover(("color", "a", "b"))),
            (1, 6, [("background", None), ("text", "junk")], None),
            (None, 7, [blue, white], hover(("color", "a", "b"))),
        ],
        NODES,
    )


def test_colors(spark):
    rows = spark.createDataFrame([("#abc",), ("#ABCD",), ("#102030",), ("#10203040",), ("rgb(1, 2, 255)",), ("rgba(1 2 3 / 50%)",), ("RGBA(1,2,3,0.5)",), ("#12",), ("",), (None,), ("red-ish",)], "css string")
    got = [r[0] for r in rows.select(R.hex_of(F.col("css"))).collect()]
    assert got == ["#aabbcc", "#aabbcc", "#102030", "#102030", "#0102ff", "#010203", "#010203", None, None, None, None]


def test_roles_and_states(nodes, palette):
    roles = R.nearest_roles(nodes.select("capture_id", R.base_color().alias("css")), palette)
    assert sorted((r.css, r.role) for r in roles.collect()) == [("#fefefe", "background"), ("rgb(32, 80, 192)", "primary")]
    got = [(r.capture_id, r.place, r.target, r.state, [tuple(c) for c in r.changes]) for r in R.role_states(nodes, palette).orderBy("place").collect()]
    assert got == [
        (1, 1, "primary", "hover", [("background-color", "#2050c0", "#000000"), ("box-shadow", "none", "0 1px"), ("color", "inherit", "#ffffff")]),
        (1, 2, "background", "active", [("color", "#000000", "#111111")]),
    ]
    assert R.role_states(nodes.limit(0), palette).count() == 0 == R.role_states(nodes, palette.limit(0)).count()


def test_on_primary(nodes, palette):
    assert sorted(tuple(r) for r in R.on_primary(nodes, palette).filter("capture_id IS NOT NULL").collect()) == [(1, "#eeeeee", False), (2, "#000000", True)]


def test_merged_states(spark, nodes):
    more = [(1, 4, 1, [("hover", [("color", "x", "y"), ("outline", "p", "q"), ("outline", "r", "s")]), ("focus", [("color", "1", "2")])]), (1, 4, 0, [("focus", [("top", "0", "1")])]), (1, 6, 0, [("hover", [])]), (9, 9, 0, [("hover", [])])]
    extra = spark.createDataFrame(more, NODES.split(", colors")[0] + ", place int, states " + NODES.split(", states ")[1])
    got = {r.ord: r.states for r in R.merged_states(nodes, extra).filter("capture_id = 1").collect()}
    assert [(s.state, [tuple(c) for c in s.changes]) for s in got[4]] == [("hover", [("color", "a", "b"), ("outline", "p", "q")]), ("focus", [("top", "0", "1"), ("color", "1", "2")])]
    assert [(s.state, s.changes) for s in got[6]] == [("hover", [])] and len(got) == 7
    frames = spark.sql("SELECT array(named_struct('name', 'a', 'n', 1)) AS own, array(named_struct('name', 'b', 'n', 2), named_struct('name', 'a', 'n', 3), named_struct('name', 'b', 'n', 4)) AS more")
    assert [tuple(x) for x in frames.select(R.merged_keyframes(F.col("own"), F.col("more")).alias("k")).first().k] == [("a", 1), ("b", 2)]


def moved(colors, moves):
    """The rule of moves as a loop."""
    colors, changes = [dict(c) for c in colors], []
    for h, role in moves:
        found = [c for c in colors if c["hex"].lower() == h.lower()]
        if len(found) > 1:
            found = [c for c in found if c["role"] in A.REFINABLE]
        if len(found) != 1 or found[0]["role"] == role:
            continue
        (target,) = found
        old = target["role"]
        for holder in [c for c in colors if c is not target and c["role"] == role][:1]:
            new = old if old in A.REFINABLE else None
            holder.update(role=new, name=new, usage=A.USAGE.get(new))
        target.update(role=role, name=role, usage=A.USAGE[role])
        changes.append((target["hex"], old, role))
    rank = {r: k for k, r in enumerate(A.REFINABLE)}
    return sorted(colors, key=lambda c: rank.get(c["role"], 99) if c["role"] else 999), changes


def test_moves_of_roles(spark):
    rng = random.Random(5)
    cases = []
    for k in range(300):
        hexes = [f"#{'abc'[rng.randrange(3)]}{rng.randrange(4)}0000" for _ in range(rng.randrange(9))]
        roles = rng.sample([*A.USAGE, *[None] * 6], len(hexes))
        colors = [{"hex": h, "role": r, "name": r or "n", "usage": A.USAGE.get(r)} for h, r in zip(hexes, roles, strict=True)]
        moves = [(rng.choice([*hexes, "#A10000"]), rng.choice(A.REFINABLE)) for _ in range(rng.randrange(6))]
        cases.append((k, colors, moves))
    rows = spark.createDataFrame(
        [(k, [(c["hex"], c["role"], c["name"], c["usage"]) for c in colors], moves) for k, colors, moves in cases],
        "k int, colors array<struct<hex:string,role:string,name:string,usage:string>>, moves array<struct<hex:string,role:string>>",
    )
    got = {r.k: r.x for r in rows.select("k", A.refined(F.col("colors"), F.col("moves")).alias("x")).collect()}
    for k, colors, moves in cases:
        want, changes = moved(colors, moves)
        assert [c.asDict() for c in got[k].colors] == want and [tuple(c) for c in got[k].changes] == changes


GOOD = {"identity": {"adjectives": ["a", "b", "c"], "archetype": "x", "description": "d"}, "imageMood": {"hero": ["h"], "texture": ["t"]}, "roleRefinements": [{"hex": "#AABBCC", "role": "text"}]}


def test_interpretations(spark):
    def but(path, value):
        out = json.loads(json.dumps(GOOD))
        at = out
        for p in path[:-1]:
            at = at[p]
        if value is ...:
            del at[path[-1]]
        else:
            at[path[-1]] = value
        return json.dumps(out)

    bad = [
        but(["identity", "adjectives"], ["a", "b"]), but(["identity", "adjectives"], [1, 2, 3]), but(["identity", "adjectives"], list("abcdefg")), but(["identity", "archetype"], ""), but(["identity", "description"], 5),
        but(["imageMood", "hero"], []), but(["imageMood"], ...), but(["roleRefinements"], None), but(["roleRefinements"], [{"hex": "#AABBCC", "role": "danger"}]), but(["roleRefinements"], [{"hex": "blue", "role": "text"}]),
        but(["roleRefinements"], "text"), "[]", "", None, "no json",
    ]
    fine = [json.dumps(GOOD), "Sure: " + json.dumps(GOOD) + " done", but(["roleRefinements"], ...), but(["roleRefinements"], []), but(["more"], 1)]
    rows = [(k, 1, t, None) for k, t in enumerate(bad)] + [(100 + k, 1, t, None) for k, t in enumerate(fine)]
    rows += [(200, 1, "junk", None), (200, 2, fine[0], None), (201, 1, None, "429"), (201, 2, fine[0], "late"), (202, 3, fine[0], None), (203, 2, fine[2], None), (203, 1, fine[0], None)]
    got = {r.capture_id: r for r in A.interpretations(spark.createDataFrame(rows, "capture_id int, attempt int, text string, error string")).collect()}
    assert sorted(got) == [100, 101, 102, 103, 104, 200, 203]
    assert got[100].adjectives == ["a", "b", "c"] and got[101].refinements[0].role == "text" and got[102].refinements == [] and len(got[203].refinements) == 1


def test_names_descriptions_and_stability(spark):
    parts = spark.createDataFrame([(1, "n1", "Box", "atom", 7), (1, "n2", "Box", "atom", 8), (2, "n1", "Box", "atom", 9)], "capture_id int, id string, name string, kind string, size int")
    updates = spark.createDataFrame([(1, 0, "n1", "Old", "region"), (1, 1, "n1", "Hero", "region"), (1, 2, "zz", "Z", "atom")], "capture_id int, place int, id string, name string, kind string")
    assert sorted(tuple(r) for r in A.renamed(parts, updates).collect()) == [(1, "n1", "Hero", "region", 7, "ai"), (1, "n2", "Box", "atom", 8, "ai"), (2, "n1", "Box", "atom", 9, "heuristic")]
    texts = spark.createDataFrame([(1, 0, "n1", "first"), (1, 1, "n1", "last"), (1, 0, "zz", "none")], "capture_id int, place int, id string, description string")
    assert sorted((r.capture_id, r.id, r.description) for r in A.described(parts, texts).collect()) == [(1, "n1", "last"), (1, "n2", None), (2, "n1", None)]
    runs = [(1, k, [" Calm", "bold"], "Dev-Tool site") for k in (1, 2, 3)] + [(2, 1, ["a"], "x"), (2, 2, ["a"], "x")] + [(3, 1, [], "!"), (3, 2, [], ""), (3, 3, ["b"], "x")]
    got = {r.capture_id: r for r in A.stability(spark.createDataFrame(runs, "capture_id int, run int, adjectives array<string>, archetype string")).collect()}
    assert sorted(got) == [1, 3] and got[1].ok and got[1].archetype == 1.0 and abs(got[3].adjectives - 1 / 3) < 1e-12 and not got[3].ok
    kinds = spark.createDataFrame([("code 429",), ("Quota gone",), ("400 x",), ("BadRequest",), ("timeout",), (None,)], "m string").select(A.failure_kind(F.col("m")))
    assert [r[0] for r in kinds.collect()] == ["429 Rate Limit / Quota Exceeded"] * 2 + ["400 Bad Request"] * 2 + ["error"] * 2
