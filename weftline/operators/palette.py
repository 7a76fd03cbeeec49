"""Palette operators: colour mathematics, merging, roles, contrast, histograms."""

from __future__ import annotations

from weftline.functions import color as C
from weftline.plans.dialect import layered, step

from . import views

MERGE = 1.5
MIN_TEXT_CONTRAST = 4.5
#: Emit order of roles.
ROLES = ("background", "danger", "warning", "success", "surface", "text", "primary", "accent", "border", "muted")


@step
def kernel(d) -> str:
    """H1-H5: hex, Lab, OKLCH, luminance and neutrality of every observed colour."""
    base = f"SELECT DISTINCT r, g, b FROM ({views.color_obs(d)}) o"
    full = layered(d, base, [*C.lab_layers(), *C.oklch_layers()])
    r = lambda x: f"round({x}, 6)"
    return f"SELECT {C.hex_of(d, 'r', 'g', 'b')} AS hex, {r('lab_l')} AS lab_l, {r('lab_a')} AS lab_a, {r('lab_b')} AS lab_b, {r('ok_l')} AS ok_l, {r('ok_c')} AS ok_c, round(ok_h, 4) AS ok_h, {r(C.luminance())} AS lum, {C.neutral('ok_c')} AS neutral FROM ({full}) f"


def parse_css(d) -> str:
    """CSS colours in hex or rgb(a) notation to channels; transparent and unreadable ones are null."""
    s = "string" if d.spark else "varchar"
    obs = f"""SELECT capture_id, ord, CASE ord % 4 WHEN 0 THEN {C.hex_of(d, 'r', 'g', 'b')} WHEN 1 THEN concat('rgb(', cast(r AS {s}), ', ', cast(g AS {s}), ', ', cast(b AS {s}), ')')
 WHEN 2 THEN concat('rgba(', cast(r AS {s}), ', ', cast(g AS {s}), ', ', cast(b AS {s}), ', ', CASE WHEN ord % 8 = 2 THEN '0' ELSE '0.5' END, ')') ELSE CASE WHEN ord % 3 = 0 THEN 'transparent' ELSE 'none' END END AS css FROM ({views.color_obs(d)}) o"""
    pair = lambda i: f"cast(concat('0x', substr(css, {i}, 2)) AS int)" if not d.spark else f"cast(conv(substr(css, {i}, 2), 16, 10) AS int)"
    nums = d.rx_all("css", "([0-9.]+)", 1)
    part = lambda k: f"cast({d.num(d.get('nums', k))} AS int)"
    is_hex, is_rgb = d.like("css", "^#[0-9a-fA-F]{6}$"), "css LIKE 'rgb%'"
    return f"""SELECT capture_id, ord, css, NOT (css IN ('', 'none', 'transparent') OR ({is_rgb} AND coalesce({d.num(d.get('nums', 4))}, 1) = 0)) AS opaque,
 CASE WHEN {is_hex} THEN {pair(2)} WHEN {is_rgb} THEN {part(1)} END AS r, CASE WHEN {is_hex} THEN {pair(4)} WHEN {is_rgb} THEN {part(2)} END AS g, CASE WHEN {is_hex} THEN {pair(6)} WHEN {is_rgb} THEN {part(3)} END AS b
 FROM (SELECT *, {nums} AS nums FROM ({obs}) c) n"""


@step(cut=True)
def distinct_colors(d) -> str:
    """Colours of a capture, numbered in the order they were first seen."""
    return f"""SELECT *, cast(row_number() OVER (PARTITION BY capture_id ORDER BY first_ord) AS int) AS ix FROM (
 SELECT capture_id, r, g, b, min(ord) AS first_ord, count(*) AS total, count_if(channel = 'background') AS n_background, count_if(channel = 'text') AS n_text, count_if(channel = 'border') AS n_border,
        count_if(channel = 'fill') AS n_fill, count_if(channel = 'stroke') AS n_stroke, count_if(interactive) AS n_interactive, count_if(semantic) AS n_semantic
 FROM ({views.color_obs(d)}) o GROUP BY capture_id, r, g, b) f"""


@step(cut=True)
def pairs(d) -> str:
    """Each colour of a capture with the earlier ones: CIEDE2000. A capture has a bounded number of colours."""
    cols = layered(d, distinct_colors(d), C.lab_layers())
    return layered(d, f"""SELECT a.capture_id, a.ix AS ix, b.ix AS earlier, a.lab_l AS a_lab_l, a.lab_a AS a_lab_a, a.lab_b AS a_lab_b, b.lab_l AS b_lab_l, b.lab_a AS b_lab_a, b.lab_b AS b_lab_b
 FROM ({cols}) a JOIN ({cols}) b ON a.capture_id = b.capture_id AND b.ix < a.ix""",
        C.delta_e_layers(),
    )


def delta_e(d) -> str:
    return f"SELECT capture_id, ix, earlier, round(de, 6) AS de FROM ({pairs(d)}) p"


@step(cut=True)
def merged(d) -> str:
    """The first colour within MERGE of an earlier kept one joins it, else it is kept itself. capture_id, ix, canon."""
    near = f"SELECT capture_id, ix, {d.gather('earlier')} AS near FROM ({pairs(d)}) p WHERE de <= {MERGE} GROUP BY capture_id, ix"
    rows = f"SELECT c.capture_id, c.ix, coalesce(n.near, {d.none('int')}) AS near FROM ({distinct_colors(d)}) c LEFT JOIN ({near}) n ON c.capture_id = n.capture_id AND c.ix = n.ix"
    if d.spark:
        fold = d.fold("every", d.none("int"), "acc", "x", f"CASE WHEN {d.any('x.near', 'n', 'array_contains(acc, n)')} THEN acc ELSE array_append(acc, x.ix) END")
        kept = f"SELECT capture_id, {fold} AS canon FROM (SELECT capture_id, {d.gather(d.struct(ix='ix', near='near'))} AS every FROM ({rows}) r GROUP BY capture_id) e"
    else:
        fold = d.fold("every", d.none("int"), "acc", "x", "CASE WHEN len(list_intersect(acc, x[2:])) > 0 THEN acc ELSE list_append(acc, x[1]) END")
        kept = f"SELECT capture_id, {fold} AS canon FROM (SELECT capture_id, list(list_prepend(ix, near) ORDER BY ix) AS every FROM ({rows}) r GROUP BY capture_id) e"
    return f"SELECT r.capture_id, r.ix, CASE WHEN {d.has('k.canon', 'r.ix')} THEN r.ix ELSE {'array_min' if d.spark else 'list_min'}({d.both('r.near', 'k.canon')}) END AS canon FROM ({rows}) r JOIN ({kept}) k ON r.capture_id = k.capture_id"


@step(cut=True)
def canonical(d) -> str:
    """Counts of the merged colours by channel, interactivity and semantic use."""
    sums = ", ".join(f"cast(sum({c}) AS bigint) AS {c}" for c in ("total", "n_background", "n_text", "n_border", "n_fill", "n_stroke", "n_interactive", "n_semantic"))
    return f"""SELECT m.capture_id, m.canon AS ix, max(CASE WHEN c.ix = m.canon THEN c.r END) AS r, max(CASE WHEN c.ix = m.canon THEN c.g END) AS g, max(CASE WHEN c.ix = m.canon THEN c.b END) AS b, {sums}
 FROM ({distinct_colors(d)}) c JOIN ({merged(d)}) m ON c.capture_id = m.capture_id AND c.ix = m.ix GROUP BY m.capture_id, m.canon"""


@step(cut=True)
def scored(d) -> str:
    """Canonical colours with area, OKLCH and luminance. D2: the area is the share of pixels where a capture's pixels are given, else the share of background use."""
    full = layered(d, canonical(d), [*C.lab_layers(), *C.oklch_layers()])
    area = "cast(n_background AS double) / greatest(1, sum(n_background) OVER (PARTITION BY capture_id))"
    if "pixel_hist" in d.names:
        full = f"SELECT c.*, w.area_weight FROM ({full}) c LEFT JOIN ({nearest_canon(d)}) w ON c.capture_id = w.capture_id AND c.ix = w.ix"
        area = "coalesce(area_weight, 0.0)"
    return f"SELECT capture_id, ix, r, g, b, total, n_background, n_text, n_border, n_interactive, n_semantic, ok_c, ok_h, {C.luminance()} AS lum, {C.neutral('ok_c')} AS neutral, {area} AS area FROM ({full}) f"


def assign(colors):
    """The ten picks of one capture (a bounded number of colours)."""
    import numpy as np
    import pandas as pd

    c = colors.sort_values("ix").reset_index(drop=True)
    free = np.ones(len(c), bool)
    lum, chroma, hue = c["lum"].to_numpy(), c["ok_c"].to_numpy(), c["ok_h"].to_numpy()
    plain, total = c["neutral"].to_numpy(), c["total"].to_numpy().astype(float)
    text, border = c["n_text"].to_numpy().astype(float), c["n_border"].to_numpy().astype(float)
    out, anchor = [], None

    def pick(role, score, ok=True):
        s = np.where(free & ok, np.round(score, 9), 0.0)
        if not s.size or s.max() <= 0:
            return None
        k = int(s.argmax())
        free[k] = False
        out.append((c["capture_id"][0], role, ROLES.index(role), int(c["ix"][k])))
        return k

    back = np.where(c["n_background"] > 0, c["area"] * np.where(plain, 1.0, 0.6), 0.0)
    if (k := pick("background", back)) is not None:
        anchor = lum[k]
    use = np.where(plain, 0.0, c["n_semantic"] * chroma)
    for role, inside in (("danger", (hue >= 345) | (hue <= 40)), ("warning", (hue >= 40) & (hue <= 95)), ("success", (hue >= 95) & (hue <= 170))):
        pick(role, np.where(inside, use, 0.0))
    pick("surface", back)
    ratio = np.ones(len(c)) if anchor is None else (np.maximum(lum, anchor) + 0.05) / (np.minimum(lum, anchor) + 0.05)
    words = np.where(text > 0, text / np.maximum(1, total) * 0.4 + np.minimum(ratio / 21, 1) * 0.6 + np.log1p(text) * 0.05, 0.0)
    if pick("text", words, ratio >= MIN_TEXT_CONTRAST if anchor is not None else True) is None and anchor is not None:
        pick("text", np.where(text > 0, ratio, 0.0))
    brand = np.where(plain, 0.0, chroma * np.log1p(total) * np.where(c["n_interactive"] > 0, 2.0, 1.0))
    pick("primary", brand)
    pick("accent", brand)
    pick("border", np.where(border > 0, border / np.maximum(1, total) * np.where(plain, 1.0, 0.5), 0.0))
    pick("muted", np.where(plain, np.log1p(total) * np.where(c["area"] > 0.25, 0.2, 1.0), 0.0))
    return pd.DataFrame(out, columns=["capture_id", "role", "rank", "ix"])


@step(cut=True)
def roles(d) -> str:
    """Ten picks in a fixed order; each takes the untaken colour with the largest positive score, the first seen among equals.

    Text must reach 4.5:1 against the background; if none does, the text colour of the highest contrast is taken. Merged colours
    are further apart than MERGE, so surface and accent are distinct from background and primary.
    """
    if d.spark:
        scored(d)
        return "scored", assign, "capture_id bigint, role string, rank int, ix int"
    fields = ("ix", "total", "n_background", "n_text", "n_border", "n_interactive", "n_semantic", "ok_c", "ok_h", "lum", "neutral", "area")
    sql = f"SELECT capture_id, {d.gather(d.struct(**{f: f for f in fields}))} AS cs, {d.none('int')} AS taken0 FROM ({scored(d)}) s GROUP BY capture_id"
    num = "double"
    back = "CASE WHEN c.n_background > 0 THEN c.area * (CASE WHEN c.neutral THEN 1.0 ELSE 0.6 END) ELSE 0.0 END"
    band = lambda lo, hi: f"CASE WHEN c.n_semantic > 0 AND NOT c.neutral AND {f'(c.ok_h >= {lo} OR c.ok_h <= {hi})' if lo > hi else f'c.ok_h BETWEEN {lo} AND {hi}'} THEN c.n_semantic * c.ok_c ELSE 0.0 END"
    against = C.contrast("c.lum", "back_lum")
    word = f"CASE WHEN c.n_text = 0 THEN 0.0 ELSE cast(c.n_text AS {num}) / greatest(1, c.total) * 0.4 + least((CASE WHEN back_lum IS NULL THEN 1.0 ELSE {against} END) / 21.0, 1.0) * 0.6 + ln(1.0 + c.n_text) * 0.05 END"
    brand = "CASE WHEN c.neutral THEN 0.0 ELSE c.ok_c * ln(1.0 + c.total) * (CASE WHEN c.n_interactive > 0 THEN 2.0 ELSE 1.0 END) END"
    border = f"CASE WHEN c.n_border = 0 THEN 0.0 ELSE cast(c.n_border AS {num}) / greatest(1, c.total) * (CASE WHEN c.neutral THEN 1.0 ELSE 0.5 END) END"
    muted = "CASE WHEN NOT c.neutral THEN 0.0 ELSE ln(1.0 + c.total) * (CASE WHEN c.area > 0.25 THEN 0.2 ELSE 1.0 END) END"
    steps = [
        ("background", back, "true"), ("danger", band(345, 40), "true"), ("warning", band(40, 95), "true"), ("success", band(95, 170), "true"), ("surface", back, "true"),
        ("text", word, f"(back_lum IS NULL OR {against} >= {MIN_TEXT_CONTRAST})"), ("text2", f"CASE WHEN c.n_text > 0 THEN {against} ELSE 0.0 END", "k_text IS NULL AND back_lum IS NOT NULL"),
        ("primary", brand, "true"), ("accent", brand, "true"), ("border", border, "true"), ("muted", muted, "true"),
    ]
    n = 0
    for role, score, ok in steps:
        free = d.keep("cs", "c", f"NOT {d.has(f'taken{n}', 'c.ix')} AND {ok} AND ({score}) > 0")
        best = d.top(d.map(free, "c", d.struct(s=f"round({score}, 9)", n="-c.ix")))
        sql = d.step(f"pick_{role}", lambda sql=sql, best=best, role=role: f"SELECT *, -({best}).n AS k_{role} FROM ({sql}) q")
        sql = f"SELECT *, CASE WHEN k_{role} IS NULL THEN taken{n} ELSE {d.append(f'taken{n}', f'k_{role}')} END AS taken{n + 1} FROM ({sql}) p{n}"
        if role == "background":
            sql = d.step("anchored", lambda sql=sql: f"SELECT *, {d.get(d.map(d.keep('cs', 'c', 'c.ix = k_background'), 'c', 'c.lum'), 1)} AS back_lum FROM ({sql}) b")
        n += 1
    sql_of = sql
    sql = d.step("picked", lambda: sql_of)
    picks = " UNION ALL ".join(f"SELECT capture_id, '{r}' AS role, {k} AS rank, {'coalesce(k_text, k_text2)' if r == 'text' else 'k_' + r} AS ix FROM ({sql}) z WHERE {'coalesce(k_text, k_text2)' if r == 'text' else 'k_' + r} IS NOT NULL" for k, r in enumerate(ROLES))
    return picks


def palette(d) -> str:
    """The swatches of a capture in role order."""
    return f"SELECT p.capture_id, p.role, p.rank, {C.hex_of(d, 's.r', 's.g', 's.b')} AS hex, {d.round_half_up('s.area', 3)} AS area_weight FROM ({roles(d)}) p JOIN ({scored(d)}) s ON p.capture_id = s.capture_id AND p.ix = s.ix"


def contrast_pairs(d) -> str:
    """Ratio to one decimal; the grade comes from the ratio before rounding. On-primary is white unless black contrasts more."""
    sw = f"SELECT p.capture_id, p.role, s.lum FROM ({roles(d)}) p JOIN ({scored(d)}) s ON p.capture_id = s.capture_id AND p.ix = s.ix"
    sw = f"SELECT * FROM ({sw}) w UNION ALL SELECT capture_id, 'on-primary' AS role, CASE WHEN {C.contrast('1.0', 'lum')} >= {C.contrast('0.0', 'lum')} THEN 1.0 ELSE 0.0 END AS lum FROM ({sw}) w WHERE role = 'primary'"
    which = "(a.role = 'text' AND b.role = 'background') OR (a.role = 'primary' AND b.role = 'background') OR (a.role = 'text' AND b.role = 'surface') OR (a.role = 'muted' AND b.role = 'surface') OR (a.role = 'on-primary' AND b.role = 'primary')"
    ratio = C.contrast("a.lum", "b.lum")
    return f"SELECT a.capture_id, a.role AS fore, b.role AS back, {d.round_half_up(ratio, 1)} AS ratio, {C.grade(f'round({ratio}, 9)')} AS grade FROM ({sw}) a JOIN ({sw}) b ON a.capture_id = b.capture_id AND ({which})"


def nearest_canon(d) -> str:
    """Pixels to the nearest canonical colour by squared Lab distance of at most 225; credited share of all pixels."""
    px = layered(d, f"SELECT capture_id, r, g, b, n FROM ({views.pixel_hist(d)}) h", C.lab_layers())
    cn = layered(d, f"SELECT capture_id, ix, r, g, b FROM ({canonical(d)}) c", C.lab_layers())
    dist = "(p.lab_l - c.lab_l) * (p.lab_l - c.lab_l) + (p.lab_a - c.lab_a) * (p.lab_a - c.lab_a) + (p.lab_b - c.lab_b) * (p.lab_b - c.lab_b)"
    best = f"SELECT p.capture_id, p.r, p.g, p.b, max(p.n) AS n, min({d.struct(dd=f'round({dist}, 6)', ix='c.ix')}) AS near FROM ({px}) p JOIN ({cn}) c ON p.capture_id = c.capture_id GROUP BY p.capture_id, p.r, p.g, p.b"
    whole = f"SELECT capture_id, sum(n) AS pixels FROM ({px}) p GROUP BY capture_id"
    return f"SELECT b.capture_id, b.near.ix AS ix, cast(sum(b.n) AS bigint) AS credited, round(cast(sum(b.n) AS double) / max(w.pixels), 6) AS area_weight FROM ({best}) b JOIN ({whole}) w ON b.capture_id = w.capture_id WHERE b.near.dd <= 225 GROUP BY b.capture_id, b.near.ix"


def buckets(d, centroid: bool) -> str:
    key = "cast(floor(r / 16) AS int) * 256 + cast(floor(g / 16) AS int) * 16 + cast(floor(b / 16) AS int)"
    h = f"SELECT *, {key} AS bucket FROM ({views.pixel_hist(d)}) h"
    if centroid:
        mean = lambda c: f"cast({d.round_half_up(f'cast(sum({c} * n) AS double) / sum(n)')} AS int) AS {c}"
        return f"SELECT capture_id, bucket, cast(sum(n) AS bigint) AS n, {mean('r')}, {mean('g')}, {mean('b')} FROM ({h}) k GROUP BY capture_id, bucket"
    first = d.struct(f="first_ix", r="r", g="g", b="b")
    return f"SELECT capture_id, bucket, n, (lo).r AS r, (lo).g AS g, (lo).b AS b FROM (SELECT capture_id, bucket, cast(sum(n) AS bigint) AS n, min({first}) AS lo FROM ({h}) k GROUP BY capture_id, bucket) m"


@step
def clusters(d) -> str:
    """D3, F8: buckets of at least 2 % of a capture's pixels, largest first, with the colour of their first pixel."""
    return f"SELECT capture_id, bucket, r, g, b, n, round(share, 6) AS share, row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, bucket) AS rank FROM (SELECT *, cast(n AS double) / sum(n) OVER (PARTITION BY capture_id) AS share FROM ({buckets(d, False)}) k) s WHERE share >= 0.02"


def image_roles(d) -> str:
    """Background is the largest neutral cluster or else the largest; primary the one of largest chroma unless it is taken; text the one of most contrast."""
    full = layered(d, buckets(d, True), [*C.lab_layers(), *C.oklch_layers()])
    c = f"SELECT *, {C.luminance()} AS lum FROM ({full}) f"
    back = f"SELECT capture_id, max({d.struct(k=C.neutral('ok_c'), n='n', o='-bucket')}) AS m FROM ({c}) c GROUP BY capture_id"
    rest = f"SELECT c.*, -(b.m).o AS back FROM ({c}) c JOIN ({back}) b ON c.capture_id = b.capture_id"
    rest = f"SELECT r.*, x.lum AS back_lum FROM ({rest}) r JOIN ({c}) x ON x.capture_id = r.capture_id AND x.bucket = r.back"
    ratio = f"round({C.contrast('lum', 'back_lum')}, 6)"
    picks = f"SELECT capture_id, max(back) AS background, -max({d.struct(s=ratio, o='-bucket')}).o AS text, -max({d.struct(s='round(ok_c, 9)', o='-bucket')}).o AS vivid, max(round(ok_c, 9)) AS top FROM ({rest}) r GROUP BY capture_id"
    return f"SELECT capture_id, background, CASE WHEN text <> background THEN text END AS text, CASE WHEN vivid <> background AND top >= 0.045 THEN vivid END AS primary_bucket FROM ({picks}) p"


def dark_gate(d) -> str:
    """Pairs of captures (light, dark) whose backgrounds differ by at least 10."""
    bg = layered(d, f"SELECT p.capture_id, s.r, s.g, s.b FROM ({roles(d)}) p JOIN ({scored(d)}) s ON p.capture_id = s.capture_id AND p.ix = s.ix WHERE p.role = 'background'", C.lab_layers())
    both = f"SELECT a.capture_id AS light, b.capture_id AS dark, a.lab_l AS a_lab_l, a.lab_a AS a_lab_a, a.lab_b AS a_lab_b, b.lab_l AS b_lab_l, b.lab_a AS b_lab_a, b.lab_b AS b_lab_b FROM ({bg}) a JOIN ({bg}) b ON b.capture_id = a.capture_id + 1"
    return f"SELECT light, dark, round(de, 6) AS de FROM ({layered(d, both, C.delta_e_layers())}) e WHERE de >= 10"


def expected_roles(d) -> str:
    """Hits (CIEDE2000 at most 12) and mean difference of roles against an expected palette, here the one of capture 1."""
    sw = layered(d, f"SELECT p.capture_id, p.role, s.r, s.g, s.b FROM ({roles(d)}) p JOIN ({scored(d)}) s ON p.capture_id = s.capture_id AND p.ix = s.ix", C.lab_layers())
    both = f"SELECT a.capture_id, e.role, e.lab_l AS a_lab_l, e.lab_a AS a_lab_a, e.lab_b AS a_lab_b, a.lab_l AS b_lab_l, a.lab_a AS b_lab_a, a.lab_b AS b_lab_b FROM ({sw}) a JOIN ({sw}) e ON a.role = e.role AND e.capture_id = 1"
    return f"SELECT capture_id, count(*) AS roles, round(avg(CASE WHEN de <= 12 THEN 1.0 ELSE 0.0 END), 6) AS hit_fraction, round(avg(de), 6) AS mean_de FROM ({layered(d, both, C.delta_e_layers())}) x GROUP BY capture_id"


PLANS = {
    "h4_color_kernel": kernel, "h1_parse_css_color": parse_css, "h3_delta_e": delta_e, "c3_color_merge": merged, "d1_canonical_colors": canonical, "h7_palette_roles": palette,
    "h9_contrast_pairs": contrast_pairs, "c1_area_weights": nearest_canon, "d3_pixel_clusters": clusters, "d4_centroid_clusters": lambda d: buckets(d, True), "h12_image_roles": image_roles,
    "b28_dark_gate": dark_gate, "n1_score_palette": expected_roles,
}
