"""Nearest and similarity joins, recipe clustering, component aggregation over element boxes."""

from __future__ import annotations

from weftline.plans.dialect import step

from . import views


@step(cut=True)
def boxes(d) -> str:
    return views.boxes(d)


def nearest_box(d) -> str:
    """Each component's nearest style box by L1 distance of the bounds, at most 6.

    A box is its style box moved by 0 to 9 px in all, so some have no style box in reach. Positions are bucketed by 6 px; a box is looked for in its own and the neighbouring buckets, so the join is on equality.
    """
    cell = lambda c: f"cast(floor({c} / 6) AS int)"
    a = f"SELECT capture_id, ord, x + ord % 5 AS x, y + CASE WHEN ord % 10 >= 5 THEN 5 ELSE 0 END AS y, w, h FROM ({boxes(d)}) b"
    near = d.array("-1", "0", "1")
    a = f"SELECT *, {cell('x')} + dx AS cx, {cell('y')} + dy AS cy FROM (SELECT *, {d.explode(near, 'dy')} FROM (SELECT *, {d.explode(near, 'dx')} FROM ({a}) a) e) f"
    s = f"SELECT *, {cell('x')} AS cx, {cell('y')} AS cy FROM ({boxes(d)}) b"
    dist = "abs(a.x - s.x) + abs(a.y - s.y) + abs(a.w - s.w) + abs(a.h - s.h)"
    return f"SELECT capture_id, ord, m.ord AS style_ord, m.dist AS dist FROM (SELECT a.capture_id, a.ord, min({d.struct(dist=dist, ord='s.ord')}) AS m FROM ({a}) a JOIN ({s}) s ON a.capture_id = s.capture_id AND a.cx = s.cx AND a.cy = s.cy WHERE {dist} <= 6 GROUP BY a.capture_id, a.ord) g"


def nearest_step(d) -> str:
    """Heights to the nearest step of a scale within 2, the first among equals."""
    scale = d.array(*(str(x) for x in (4, 8, 12, 16, 24, 32, 48, 64, 96, 128, 160, 192)))
    best = f"{'array_min' if d.spark else 'list_min'}({d.map(scale, 's', d.struct(dist='abs(h - s)', s='s'))})"
    return f"SELECT capture_id, ord, h, CASE WHEN m.dist <= 2 THEN m.s END AS step FROM (SELECT capture_id, ord, h, {best} AS m FROM ({boxes(d)}) b) n"


@step
def classified(d) -> str:
    """The recipe element of a box, by the first rule that holds."""
    tag = "CASE l_linenumber % 7 WHEN 0 THEN 'button' WHEN 1 THEN 'a' WHEN 2 THEN 'input' WHEN 3 THEN 'div' WHEN 4 THEN 'span' WHEN 5 THEN 'li' ELSE 'article' END"
    b = f"SELECT *, {tag} AS tag, l_returnflag = 'A' AS in_nav, l_returnflag = 'N' AS has_text, l_linestatus = 'O' AS interactive, l_partkey % 20 AS radius, l_suppkey % 12 AS padding, l_partkey % 6 AS bg FROM ({boxes(d)}) b"
    button = "(tag = 'button' OR (tag = 'input' AND interactive))"
    card = "(tag IN ('div', 'article', 'li') AND NOT has_text AND radius > 0 AND padding > 0)"
    badge = "(tag IN ('span', 'div') AND has_text AND NOT interactive AND radius >= 8 AND bg > 0 AND h > 0 AND h <= 40)"
    return f"SELECT *, CASE WHEN {button} AND in_nav THEN 'NavItem' WHEN {button} THEN 'Button' WHEN tag = 'a' AND in_nav THEN 'NavItem' WHEN tag = 'a' THEN 'TextLink' WHEN tag IN ('input', 'select', 'textarea') THEN 'Input' WHEN {card} THEN 'Card' WHEN {badge} THEN 'Badge' END AS element FROM ({b}) b"


def elements(d) -> str:
    return f"SELECT capture_id, ord, tag, element FROM ({classified(d)}) c"


def recipes(d) -> str:
    """Variants of an element by background; kept with 3 uses or a share of 0.15, three at most; padding and radius by the most frequent, the first seen among equals."""
    c = f"SELECT capture_id, element, bg, ord, padding, radius FROM ({classified(d)}) c WHERE element IS NOT NULL"
    g = f"SELECT capture_id, element, bg, count(*) AS n, min(ord) AS first_ord FROM ({c}) c GROUP BY capture_id, element, bg"
    g = f"SELECT *, cast(n AS double) / sum(n) OVER (PARTITION BY capture_id, element) AS share FROM ({g}) g"
    g = f"SELECT *, row_number() OVER (PARTITION BY capture_id, element ORDER BY n DESC, first_ord) AS rk FROM ({g}) g WHERE n >= 3 OR share >= 0.15"
    modal = lambda v: f"SELECT capture_id, element, bg, {v} FROM (SELECT capture_id, element, bg, {v}, row_number() OVER (PARTITION BY capture_id, element, bg ORDER BY count(*) DESC, min(ord)) AS rk FROM ({c}) c GROUP BY capture_id, element, bg, {v}) m WHERE rk = 1"
    on = lambda a: f"g.capture_id = {a}.capture_id AND g.element = {a}.element AND g.bg = {a}.bg"
    return f"SELECT g.capture_id, g.element, g.bg, g.n, round(g.share, 6) AS share, p.padding, r.radius FROM ({g}) g JOIN ({modal('padding')}) p ON {on('p')} JOIN ({modal('radius')}) r ON {on('r')} WHERE g.rk <= 3"


def visible(d) -> str:
    """B1, B2: visible by the style rule (either side empty hides) and by the tree rule (both sides empty hide)."""
    return f"SELECT capture_id, count(*) AS n, count_if(NOT (w <= 0 OR h <= 0)) AS style_visible, count_if(NOT (w <= 0 AND h <= 0)) AS tree_visible, count_if(l_linestatus = 'O' AND w > 0) AS useful FROM ({boxes(d)}) b GROUP BY capture_id"


def content_width(d) -> str:
    """The most frequent width by buckets of 8 (the first seen among equals) of boxes narrower than the viewport, as a rounded mean."""
    b = f"SELECT capture_id, cast(floor(w / 8) AS int) AS bucket, count(*) AS n, min(ord) AS first_ord, avg(w) AS mean FROM ({boxes(d)}) b WHERE w > 0 AND w < 1440 - 8 GROUP BY capture_id, cast(floor(w / 8) AS int)"
    return f"SELECT capture_id, {d.round_half_up('round(mean, 6)')} AS max_width FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, first_ord) AS rk FROM ({b}) b) r WHERE rk = 1"


PLANS = {"c4_nearest_box": nearest_box, "c5_nearest_step": nearest_step, "b15_classify": elements, "d15_recipes": recipes, "b1_visibility": visible, "d22_content_width": content_width}
