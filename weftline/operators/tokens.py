"""Spacing, radius, elevation and motion scales of a capture."""

from __future__ import annotations

from weftline.plans.dialect import step

from . import views

#: Names of elevation levels, smallest first.
LEVELS = ("sm", "md", "lg", "xl")


@step
def spacing_counts(d) -> str:
    return f"SELECT capture_id, px, count(*) AS n, min(ord) AS first_ord FROM ({views.spacing_obs(d)}) o WHERE px > 0 GROUP BY capture_id, px"


def spacing(d) -> str:
    """Base unit 8 if every multiple of 4 is one of 8, else 4; values snap to multiples within 1 px; the eight most used of at least two uses, ascending."""
    base = f"SELECT *, CASE WHEN sum(CASE WHEN px % 8 = 0 THEN n ELSE 0 END) OVER w >= sum(CASE WHEN px % 4 = 0 THEN n ELSE 0 END) OVER w AND sum(CASE WHEN px % 8 = 0 THEN n ELSE 0 END) OVER w > 0 THEN 8 ELSE 4 END AS unit FROM ({spacing_counts(d)}) c WINDOW w AS (PARTITION BY capture_id)"
    snap = f"SELECT *, cast(floor(cast(px AS double) / unit + 0.5) AS int) * unit AS step FROM ({base}) b"
    used = f"SELECT capture_id, unit, step, cast(sum(n) AS bigint) AS n, min(first_ord) AS first_ord FROM ({snap}) s WHERE step > 0 AND abs(px - step) <= 1 GROUP BY capture_id, unit, step"
    best = f"SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, first_ord) AS rk FROM ({used}) u WHERE n >= 2"
    s = "string" if d.spark else "varchar"
    return f"SELECT capture_id, unit AS base_unit_px, {d.join(d.map(d.gather('step'), 'v', f'cast(v AS {s})'), ' ')} AS scale FROM ({best}) b WHERE rk <= 8 GROUP BY capture_id, unit"


@step
def radii(d) -> str:
    """A radius by name: pills are 9999px, mixed corners are their most frequent corner that is not flush (the first to reach that count)."""
    parts = d.keep(d.split("radius", r"\s+"), "x", "x <> '0px' AND x <> '0'")
    at = d.range("1", d.size("parts"))
    # the value that first reaches the largest running count
    runs = d.map(at, "i", d.struct(c=d.size(d.keep(d.slice_to("parts", "i"), "y", f"y = {d.get('parts', 'i')}")), o="-i", v=d.get("parts", "i")))
    norm = f"CASE WHEN radius = '50%' OR radius LIKE '%999%' THEN '9999px' WHEN {d.size('parts')} = 0 THEN '0px' ELSE {d.top(runs)}.v END"
    return f"SELECT capture_id, ord, radius, {norm} AS norm FROM (SELECT *, {parts} AS parts FROM ({views.css_obs(d)}) o) p"


def radius(d) -> str:
    """Distinct radii, numbers ascending and pills last, six at most."""
    number = d.num(d.rx("norm", r"^([0-9]*\.?[0-9]+)", 1))
    rows = f"SELECT capture_id, norm, CASE WHEN norm = '9999px' THEN 1 ELSE 0 END AS pill, {number} AS px FROM ({radii(d)}) r WHERE norm NOT IN ('0px', '0') GROUP BY capture_id, norm"
    return f"SELECT capture_id, {d.join(d.map(d.slice(d.gather(d.struct(pill='pill', px='px', norm='norm')), 6), 'v', 'v.norm'), ' ')} AS scale FROM ({rows}) r GROUP BY capture_id"


def radius_values(d) -> str:
    return f"SELECT capture_id, ord, radius, norm FROM ({radii(d)}) r"


@step
def shadows(d) -> str:
    """Shadows and the sum of their pixel lengths."""
    nums = d.rx_all("shadow", r"(-?[0-9]+(?:\.[0-9]+)?)px", 1)
    return f"SELECT capture_id, shadow, n, first_ord, {d.total(d.map(nums, 'v', f'abs(cast(v AS double))'))} AS magnitude FROM (SELECT capture_id, shadow, count(*) AS n, min(ord) AS first_ord FROM ({views.css_obs(d)}) o WHERE shadow NOT IN ('', 'none') GROUP BY capture_id, shadow) g"


def elevation(d) -> str:
    """The four most used shadows in order of magnitude, named sm to xl."""
    top = f"SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, first_ord) AS rk FROM ({shadows(d)}) s"
    named = f"SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY magnitude, rk) AS level FROM ({top}) t WHERE rk <= 4"
    return f"SELECT capture_id, CASE level WHEN 1 THEN 'sm' WHEN 2 THEN 'md' WHEN 3 THEN 'lg' ELSE 'xl' END AS name, shadow, magnitude FROM ({named}) n"


def motion(d) -> str:
    """Distinct motions of a capture, the first of each kept. I5: durations in ms."""
    s = "string" if d.spark else "varchar"
    o = f"SELECT user_id AS capture_id, event_id AS ord, event_type AS target, cast({d.rx('props', '([0-9]+)', 1)} AS int) % 6 AS k FROM {d.t('events')}"
    t = f"SELECT *, CASE WHEN k % 3 = 0 THEN concat(cast(k * 50 AS {s}), 'ms') WHEN k % 3 = 1 THEN concat('0.', cast(k AS {s}), 's') ELSE cast(k AS {s}) END AS dur, CASE WHEN k % 2 = 0 THEN 'ease' ELSE 'linear' END AS timing FROM ({o}) o"
    ms = f"CASE WHEN dur LIKE '%ms' THEN {d.num(d.rx('dur', '^([0-9.]+)', 1))} WHEN dur LIKE '%s' THEN {d.num(d.rx('dur', '^([0-9.]+)', 1))} * 1000 ELSE {d.num('dur')} END"
    return f"SELECT capture_id, target, timing, round(ms, 3) AS duration_ms, ord AS first_ord FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, target, timing, ms ORDER BY ord) AS rk FROM (SELECT *, {ms} AS ms FROM ({t}) t) m) r WHERE rk = 1"


def states(d) -> str:
    """For each capture, role and property the most frequent change; the first seen among equals."""
    o = f"SELECT user_id AS capture_id, event_id AS ord, event_type AS role, cast({d.rx('props', '([0-9]+)', 1)} AS int) % 4 AS prop, cast({d.rx('props', '([0-9]+)', 1)} AS int) % 9 AS change FROM {d.t('events')}"
    c = f"SELECT capture_id, role, prop, change, count(*) AS n, min(ord) AS first_ord FROM ({o}) o GROUP BY capture_id, role, prop, change"
    return f"SELECT capture_id, role, prop, change, n FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, role, prop ORDER BY n DESC, first_ord) AS rk FROM ({c}) c) r WHERE rk = 1"


PLANS = {"d12_spacing_scale": spacing, "d13_radius_scale": radius, "i15_radius_values": radius_values, "d14_elevation": elevation, "d19_motion": motion, "d18_states": states}
