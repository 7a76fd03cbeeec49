"""Answers of a model, which the engine does not call: they come as a table of responses and are checked, tried again and applied here.

responses: capture_id, attempt, text, error. Only the first two attempts count, as a request is repeated once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.styles import loose_json

#: Roles that a model may move, in the order of reports, and what reports say of each role.
REFINABLE = ("background", "surface", "text", "primary", "accent", "muted", "border")
USAGE = {
    "background": "page background", "surface": "cards, raised panels", "text": "body text", "primary": "primary actions, links", "accent": "secondary emphasis",
    "muted": "secondary text, dividers", "border": "borders, separators", "on-primary": "text/icons on primary buttons", "success": "positive/confirmation state",
    "warning": "caution/warning state", "danger": "error/destructive state",
}
ATTEMPTS = 2
RUNS, ADJECTIVES_FLOOR, ARCHETYPE_FLOOR = 3, 0.5, 0.3


def failure_kind(message: Column) -> Column:
    """M2: what kind of failure a message tells of."""
    has = lambda *words: F.greatest(*(F.contains(message, F.lit(w)) for w in words))
    limited = has("429", "RESOURCE_EXHAUSTED", "Quota", "rate limit")
    return F.when(limited, "429 Rate Limit / Quota Exceeded").when(has("400", "INVALID_ARGUMENT", "BadRequest"), "400 Bad Request").otherwise("error")


def _kind(answer: Column, path: str) -> Column:
    return F.schema_of_variant(F.variant_get(answer, path, "variant"))


def valid_interpretation(answer: Column) -> Column:
    """M3: whether a parsed answer has three to six adjectives, texts that are not empty, moods, and moves of refinable roles only."""
    texts = [(_kind(answer, f"$.identity.{f}") == "STRING") & (F.variant_get(answer, f"$.identity.{f}", "string") != "") for f in ("archetype", "description")]
    lists = [_kind(answer, p) == "ARRAY<STRING>" for p in ("$.identity.adjectives", "$.imageMood.hero", "$.imageMood.texture")]
    count = F.size(F.try_variant_get(answer, "$.identity.adjectives", "array<string>")).between(3, 6)
    given = F.variant_get(answer, "$.roleRefinements", "variant")
    moves = F.try_variant_get(answer, "$.roleRefinements", "array<struct<hex:string,role:string>>")
    sound = F.forall(moves, lambda m: F.coalesce(m["hex"].rlike("^#[0-9a-fA-F]{6}$") & m["role"].isin(*REFINABLE), F.lit(False)))
    checks = [*texts, *lists, count, F.when(given.isNull(), True).otherwise(sound)]
    return F.array_min(F.array(*(F.coalesce(c, F.lit(False)) for c in checks)))


def interpretations(responses: DataFrame) -> DataFrame:
    """M2, M3: capture_id, adjectives, archetype, description, hero, texture, refinements of the first attempt with a sound answer.

    Captures without one have no row, so a left join keeps their measured report as it is.
    """
    parsed = responses.filter((F.col("attempt") <= ATTEMPTS) & F.col("error").isNull()).select("capture_id", "attempt", F.try_parse_json(loose_json(F.col("text"))).alias("answer"))
    sound = parsed.filter(valid_interpretation(F.col("answer"))).select("capture_id", "attempt", F.to_json("answer").alias("json"))
    first = sound.groupBy("capture_id").agg(F.min(F.struct("attempt", "json")).alias("first"))
    answer = F.from_json("first.json", "identity struct<adjectives:array<string>,archetype:string,description:string>, imageMood struct<hero:array<string>,texture:array<string>>, roleRefinements array<struct<hex:string,role:string>>")
    rows = first.select("capture_id", answer.alias("a"))
    return rows.select("capture_id", "a.identity.*", "a.imageMood.*", F.coalesce("a.roleRefinements", F.array().cast("array<struct<hex:string,role:string>>")).alias("refinements"))


def _bound(value: Column, use) -> Column:
    """A value used several times within a fold, computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _with_role(swatch: Column, role: Column) -> Column:
    usage = F.element_at(F.create_map(*(F.lit(x) for pair in USAGE.items() for x in pair)), role)
    return swatch.withField("role", role).withField("name", role).withField("usage", usage)


def refined(colors: Column, moves: Column) -> Column:
    """(colors, changes) after the moves of roles, one after the other.

    colors: array of structs with hex, role, name and usage (further fields stay). A move names a swatch by its hex; of several swatches
    with that hex it means the only one whose role is refinable, else it is passed over, as is a move to the role that a swatch has.
    Who held the role takes the swatch's old one if that is refinable, else has none. Refinable roles come first, in their order, then
    other roles, then swatches without a role; equals keep their order. Null counts as no colours and no moves.
    """
    refinable = lambda role: F.coalesce(role.isin(*REFINABLE), F.lit(False))
    start = F.struct(colors.alias("colors"), F.array().cast("array<struct<hex:string,from:string,to:string>>").alias("changes"))

    def move(state: Column, m: Column) -> Column:
        here = state["colors"]
        hit = lambda c: F.lower(c["hex"]) == F.lower(m["hex"])
        places = lambda test: F.array_compact(F.transform(here, lambda c, i: F.when(test(c, i), i)))
        only = lambda xs: F.when(F.size(xs) == 1, F.get(xs, F.lit(0)))
        target = F.coalesce(only(places(lambda c, i: hit(c))), only(places(lambda c, i: hit(c) & refinable(c["role"]))))

        def applied(t: Column) -> Column:
            swatch = F.get(here, t)
            old = swatch["role"]
            holder = F.get(places(lambda c, i: (i != t) & (c["role"] == m["role"])), F.lit(0))
            gone = lambda c: c.withField("role", F.lit(None).cast("string")).withField("name", F.lit(None).cast("string")).withField("usage", F.lit(None).cast("string"))
            swapped = lambda c, i: F.when(i == t, _with_role(c, m["role"])).when(i == holder, F.when(refinable(old), _with_role(c, old)).otherwise(gone(c))).otherwise(c)
            change = F.struct(swatch["hex"].alias("hex"), old.alias("from"), m["role"].alias("to"))
            after = F.struct(F.transform(here, swapped).alias("colors"), F.array_append(state["changes"], change).alias("changes"))
            return F.when(t.isNotNull() & ~old.eqNullSafe(m["role"]), after).otherwise(state)

        return _bound(target, applied)

    done = F.aggregate(F.coalesce(moves, F.array().cast("array<struct<hex:string,role:string>>")), start, move)
    order = F.create_map(*(x for k, role in enumerate(REFINABLE) for x in (F.lit(role), F.lit(k))))
    rank = lambda role: F.when(role.isNull(), 999).otherwise(F.coalesce(F.element_at(order, role), F.lit(99)))

    def ordered(state: Column) -> Column:
        ranked = F.array_sort(F.transform(state["colors"], lambda c, i: F.struct(rank(c["role"]).alias("rank"), i.alias("at"), c.alias("c"))))
        return F.struct(F.transform(ranked, lambda x: x["c"]).alias("colors"), state["changes"].alias("changes"))

    return _bound(done, ordered)


def renamed(components: DataFrame, updates: DataFrame) -> DataFrame:
    """C11, M6: components (capture_id, id, name, kind and more) with the names and kinds of updates (capture_id, place, id, name, kind).

    The last update of an id counts; updates of unknown ids change nothing. naming is `ai` in captures that have updates, else `heuristic`.
    """
    last = updates.groupBy("capture_id", "id").agg(F.max_by(F.struct("name", "kind"), "place").alias("_new"))
    asked = updates.select("capture_id").distinct().withColumn("_asked", F.lit(True))
    rows = components.join(last, ["capture_id", "id"], "left").join(asked, "capture_id", "left")
    changed = {c: F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c) for c in ("name", "kind")}
    return rows.select(*(changed.get(c, F.col(c)) for c in components.columns), F.when(F.col("_asked"), "ai").otherwise("heuristic").alias("naming"))


def described(bands: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Bands (capture_id, id and more) with the description of their id; descriptions of unknown ids are left out, the last of an id counts."""
    last = descriptions.groupBy("capture_id", "id").agg(F.max_by("description", "place").alias("description"))
    return bands.join(last, ["capture_id", "id"], "left")


def _similarity(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def stability(runs: DataFrame) -> DataFrame:
    """capture_id, adjectives, archetype (mean similarity of each two of RUNS runs) and ok; captures with fewer runs have no row.

    runs: capture_id, run (1 to RUNS, each once), adjectives, archetype. Adjectives are compared whole, archetypes by their words.
    """
    words = F.filter(F.split(F.regexp_replace(F.lower("archetype"), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: w != "")
    rows = runs.filter(F.col("run").between(1, RUNS)).select("capture_id", "run", F.transform("adjectives", lambda a: F.trim(F.lower(a))).alias("adjectives"), words.alias("archetype"))
    wide = rows.groupBy("capture_id").agg(*(F.max_by(F.struct("adjectives", "archetype"), F.when(F.col("run") == k, 1)).alias(f"r{k}") for k in range(1, RUNS + 1)), F.countDistinct("run").alias("n")).filter(F.col("n") == RUNS)
    pairs = [(i, j) for i in range(1, RUNS + 1) for j in range(i + 1, RUNS + 1)]
    mean = lambda field: sum((_similarity(F.col(f"r{i}.{field}"), F.col(f"r{j}.{field}")) for i, j in pairs), F.lit(0.0)) / len(pairs)
    out = wide.select("capture_id", mean("adjectives").alias("adjectives"), mean("archetype").alias("archetype"))
    return out.withColumn("ok", (F.col("adjectives") >= ADJECTIVES_FLOOR) & (F.col("archetype") >= ARCHETYPE_FLOOR))
