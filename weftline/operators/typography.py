"""Typographic scale and font families of a capture."""

from __future__ import annotations

from weftline.functions import text as X
from weftline.plans.dialect import step

from . import views


@step(cut=True)
def samples(d) -> str:
    """Samples with rounded sizes of 6 to 200 px and their family."""
    return f"SELECT capture_id, ord, size, weight, line_height_px, letter_spacing, tag, family, font_family FROM (SELECT *, cast(floor(size_px + 0.5) AS int) AS size, {X.first_family(d, 'font_family')} AS family FROM ({views.type_samples(d)}) o) s WHERE size BETWEEN 6 AND 200"


@step(cut=True)
def sizes(d) -> str:
    """Uses of each size; the body is the most used, the first seen among equals."""
    c = f"SELECT capture_id, size, count(*) AS n, min(ord) AS first_ord FROM ({samples(d)}) s GROUP BY capture_id, size"
    return f"SELECT *, first_value(size) OVER (PARTITION BY capture_id ORDER BY n DESC, first_ord) AS body FROM ({c}) c"


@step(cut=True)
def scale_sizes(d) -> str:
    """Heading tokens from the bottom up, anchored at the size of h1 elements where it is above the body; small is the most used size below."""
    h = f"SELECT capture_id, size AS h1 FROM (SELECT capture_id, size, row_number() OVER (PARTITION BY capture_id ORDER BY count(*) DESC, size DESC) AS rk FROM ({samples(d)}) s WHERE tag = 'h1' GROUP BY capture_id, size) r WHERE rk = 1"
    j = f"SELECT z.*, CASE WHEN h.h1 > z.body THEN h.h1 END AS h1 FROM ({sizes(d)}) z LEFT JOIN ({h}) h ON z.capture_id = h.capture_id"
    top = f"SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, size) AS rk FROM ({j}) j WHERE size > body"
    side = f"SELECT *, CASE WHEN h1 IS NULL THEN 0 WHEN size > h1 THEN 1 WHEN size = h1 THEN 2 ELSE 3 END AS side FROM ({top}) t WHERE rk <= 4 OR size = h1"
    near = f"SELECT *, row_number() OVER (PARTITION BY capture_id, side ORDER BY size DESC) AS place FROM ({side}) s"
    kept = f"SELECT * FROM ({near}) n WHERE (side = 0) OR (side = 1 AND place = 1) OR side = 2 OR (side = 3 AND place <= 2)"
    order = f"SELECT capture_id, size, 4 - count(*) OVER (PARTITION BY capture_id) + row_number() OVER (PARTITION BY capture_id ORDER BY size DESC) AS slot FROM ({kept}) k"
    small = f"SELECT capture_id, size FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, size) AS rk FROM ({sizes(d)}) z WHERE size < body) b WHERE rk = 1"
    return f"""SELECT capture_id, size, CASE slot WHEN 1 THEN 'display' WHEN 2 THEN 'h1' WHEN 3 THEN 'h2' ELSE 'h3' END AS token FROM ({order}) o
 UNION ALL SELECT capture_id, size, 'body' AS token FROM ({sizes(d)}) z WHERE size = body UNION ALL SELECT capture_id, size, 'small' AS token FROM ({small}) m"""


def first_mode(d, value: str, rows: str, keys: str) -> str:
    """The value that is first to reach the largest count."""
    run = f"SELECT {keys}, {value} AS v, ord, count(*) OVER (PARTITION BY {keys}, {value} ORDER BY ord ROWS UNBOUNDED PRECEDING) AS run FROM ({rows}) r"
    return f"SELECT {keys}, v FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY run DESC, ord) AS rk FROM ({run}) u) w WHERE rk = 1"


def scale(d) -> str:
    """Size, weight, line height ratio and letter spacing in em of each token."""
    s = samples(d)
    keys = "capture_id, size"
    one = lambda v: first_mode(d, v, s, keys)
    em = f"{d.num(d.rx('l.v', '^(-?[0-9.]+)', 1))} / t.size"
    return f"""SELECT t.capture_id, t.token, t.size, w.v AS weight, {d.round_half_up('round(h.v / t.size, 9)', 2)} AS line_height, CASE WHEN l.v = 'normal' OR abs({em}) < 0.005 THEN 0.0 ELSE round({em}, 4) END AS letter_spacing_em
 FROM ({scale_sizes(d)}) t JOIN ({one('weight')}) w ON t.capture_id = w.capture_id AND t.size = w.size JOIN ({one('line_height_px')}) h ON t.capture_id = h.capture_id AND t.size = h.size JOIN ({one('letter_spacing')}) l ON t.capture_id = l.capture_id AND t.size = l.size"""


def families(d) -> str:
    """The body's family, the headings' if it differs, and every monospace one; each family once, with observed weights."""
    s = f"SELECT s.*, z.body, z.first_ord AS size_first FROM ({samples(d)}) s JOIN ({sizes(d)}) z ON s.capture_id = z.capture_id AND s.size = z.size"
    body = first_mode(d, "family", f"SELECT * FROM ({s}) q WHERE size = body", "capture_id")
    above = f"SELECT capture_id, family, row_number() OVER (PARTITION BY capture_id ORDER BY size_first, ord) AS ord FROM ({s}) q WHERE size > body"
    head = first_mode(d, "family", above, "capture_id")
    mono = f"SELECT capture_id, family AS v, min(ord) AS o FROM ({s}) q WHERE {X.classify(d, 'family')} = 'monospace' GROUP BY capture_id, family"
    every = f"SELECT capture_id, v, 0 AS rank, cast(0 AS bigint) AS o, 'body' AS role FROM ({body}) b UNION ALL SELECT capture_id, v, 1 AS rank, cast(0 AS bigint) AS o, 'heading' AS role FROM ({head}) h UNION ALL SELECT capture_id, v, 2 AS rank, o, 'mono' AS role FROM ({mono}) m"
    once = f"SELECT *, row_number() OVER (PARTITION BY capture_id, v ORDER BY rank) AS rk FROM ({every}) e"
    kind = "string" if d.spark else "varchar"
    weights = f"SELECT capture_id, family, {d.join(d.map(d.sort(d.uniq(d.gather('weight'))), 'w', f'cast(w AS {kind})'), ' ')} AS weights FROM ({samples(d)}) s GROUP BY capture_id, family"
    return f"SELECT o.capture_id, o.v AS family, o.role, {X.classify(d, 'o.v')} AS classification, w.weights FROM ({once}) o JOIN ({weights}) w ON o.capture_id = w.capture_id AND o.v = w.family WHERE o.rk = 1"


PLANS = {"d9_type_scale": scale, "d11_font_families": families, "d6_type_sizes": lambda d: f"SELECT capture_id, size, n, body FROM ({sizes(d)}) z"}
