"""Colour mathematics as SQL expressions: CIE Lab (D65 by default), OKLCH, CIEDE2000, WCAG contrast.

Fixed values: matrices and constants of the published definitions.
"""

from __future__ import annotations

#: Reference white D65.
WHITE = (0.95047, 1.0, 1.08883)


def linear(c: str) -> str:
    return f"(CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE power(({c} / 255.0 + 0.055) / 1.055, 2.4) END)"


def lab_layers(r: str = "r", g: str = "g", b: str = "b", p: str = "", white: tuple[float, float, float] = WHITE) -> list[dict[str, str]]:
    """lab_l, lab_a, lab_b with prefix p from 8-bit channels."""
    f = lambda t: f"(CASE WHEN {t} > 216.0 / 24389.0 THEN cbrt({t}) ELSE (24389.0 / 27.0 * {t} + 16.0) / 116.0 END)"
    return [
        {f"{p}rl": linear(r), f"{p}gl": linear(g), f"{p}bl": linear(b)},
        {
            f"{p}xx": f"(0.4124564 * {p}rl + 0.3575761 * {p}gl + 0.1804375 * {p}bl) / {white[0]}",
            f"{p}yy": f"(0.2126729 * {p}rl + 0.7151522 * {p}gl + 0.0721750 * {p}bl) / {white[1]}",
            f"{p}zz": f"(0.0193339 * {p}rl + 0.1191920 * {p}gl + 0.9503041 * {p}bl) / {white[2]}",
        },
        {f"{p}fx": f(f"{p}xx"), f"{p}fy": f(f"{p}yy"), f"{p}fz": f(f"{p}zz")},
        {f"{p}lab_l": f"116.0 * {p}fy - 16.0", f"{p}lab_a": f"500.0 * ({p}fx - {p}fy)", f"{p}lab_b": f"200.0 * ({p}fy - {p}fz)"},
    ]


def oklch_layers(p: str = "") -> list[dict[str, str]]:
    """ok_l, ok_c, ok_h (degrees, 0 where chroma vanishes) on top of lab_layers."""
    return [
        {
            f"{p}ol": f"cbrt(0.4122214708 * {p}rl + 0.5363325363 * {p}gl + 0.0514459929 * {p}bl)",
            f"{p}om": f"cbrt(0.2119034982 * {p}rl + 0.6806995451 * {p}gl + 0.1073969566 * {p}bl)",
            f"{p}os": f"cbrt(0.0883024619 * {p}rl + 0.2817188376 * {p}gl + 0.6299787005 * {p}bl)",
        },
        {
            f"{p}ok_l": f"0.2104542553 * {p}ol + 0.7936177850 * {p}om - 0.0040720468 * {p}os",
            f"{p}ok_a": f"1.9779984951 * {p}ol - 2.4285922050 * {p}om + 0.4505937099 * {p}os",
            f"{p}ok_b": f"0.0259040371 * {p}ol + 0.7827717662 * {p}om - 0.8086757660 * {p}os",
        },
        {f"{p}ok_c": f"sqrt({p}ok_a * {p}ok_a + {p}ok_b * {p}ok_b)"},
        {f"{p}ok_h": f"(CASE WHEN {p}ok_c < 0.000001 THEN 0.0 WHEN atan2({p}ok_b, {p}ok_a) < 0 THEN degrees(atan2({p}ok_b, {p}ok_a)) + 360.0 ELSE degrees(atan2({p}ok_b, {p}ok_a)) END)"},
    ]


def luminance(p: str = "") -> str:
    return f"(0.2126 * {p}rl + 0.7152 * {p}gl + 0.0722 * {p}bl)"


def contrast(a: str, b: str) -> str:
    """WCAG ratio of two luminances."""
    return f"((greatest({a}, {b}) + 0.05) / (least({a}, {b}) + 0.05))"


def grade(ratio: str) -> str:
    return f"(CASE WHEN {ratio} >= 7 THEN 'AAA' WHEN {ratio} >= 4.5 THEN 'AA' WHEN {ratio} >= 3 THEN 'AA Large' ELSE 'fail' END)"


def neutral(chroma: str) -> str:
    return f"({chroma} < 0.045)"


def hex_of(d, r: str, g: str, b: str) -> str:
    if d.spark:
        return "concat('#', " + ", ".join(f"lpad(lower(hex(cast({c} AS bigint))), 2, '0')" for c in (r, g, b)) + ")"
    return "'#' || " + " || ".join(f"lpad(lower(to_hex(CAST({c} AS BIGINT))), 2, '0')" for c in (r, g, b))


def delta_e_layers(p: str = "a_", q: str = "b_", out: str = "de") -> list[dict[str, str]]:
    """CIEDE2000 of <p>lab_* and <q>lab_* as column `out`."""
    L1, A1, B1, L2, A2, B2 = (f"{x}lab_{c}" for x in (p, q) for c in "lab")
    hue = lambda a, b: f"(CASE WHEN {a} = 0 AND {b} = 0 THEN 0.0 WHEN atan2({b}, {a}) < 0 THEN degrees(atan2({b}, {a})) + 360.0 ELSE degrees(atan2({b}, {a})) END)"
    return [
        {"c_mean": f"(sqrt({A1} * {A1} + {B1} * {B1}) + sqrt({A2} * {A2} + {B2} * {B2})) / 2.0"},
        {"g_fac": "0.5 * (1.0 - sqrt(power(c_mean, 7) / (power(c_mean, 7) + 6103515625.0)))"},
        {"ap1": f"{A1} * (1.0 + g_fac)", "ap2": f"{A2} * (1.0 + g_fac)"},
        {"cp1": f"sqrt(ap1 * ap1 + {B1} * {B1})", "cp2": f"sqrt(ap2 * ap2 + {B2} * {B2})", "hp1": hue("ap1", B1), "hp2": hue("ap2", B2)},
        {
            "dl": f"{L2} - {L1}", "dc": "cp2 - cp1",
            "dh": "(CASE WHEN cp1 * cp2 = 0 THEN 0.0 WHEN abs(hp2 - hp1) <= 180 THEN hp2 - hp1 WHEN hp2 - hp1 > 180 THEN hp2 - hp1 - 360.0 ELSE hp2 - hp1 + 360.0 END)",
            "l_bar": f"({L1} + {L2}) / 2.0", "c_bar": "(cp1 + cp2) / 2.0",
            "h_bar": "(CASE WHEN cp1 * cp2 = 0 THEN hp1 + hp2 WHEN abs(hp1 - hp2) <= 180 THEN (hp1 + hp2) / 2.0 WHEN hp1 + hp2 < 360 THEN (hp1 + hp2 + 360.0) / 2.0 ELSE (hp1 + hp2 - 360.0) / 2.0 END)",
        },
        {
            "dhh": "2.0 * sqrt(cp1 * cp2) * sin(radians(dh / 2.0))",
            "t_fac": "1.0 - 0.17 * cos(radians(h_bar - 30.0)) + 0.24 * cos(radians(2.0 * h_bar)) + 0.32 * cos(radians(3.0 * h_bar + 6.0)) - 0.20 * cos(radians(4.0 * h_bar - 63.0))",
            "s_l": "1.0 + 0.015 * power(l_bar - 50.0, 2) / sqrt(20.0 + power(l_bar - 50.0, 2))", "s_c": "1.0 + 0.045 * c_bar",
            "r_t": "-2.0 * sqrt(power(c_bar, 7) / (power(c_bar, 7) + 6103515625.0)) * sin(radians(60.0 * exp(-power((h_bar - 275.0) / 25.0, 2))))",
        },
        {"s_h": "1.0 + 0.015 * c_bar * t_fac"},
        {out: "sqrt(greatest(0.0, power(dl / s_l, 2) + power(dc / s_c, 2) + power(dhh / s_h, 2) + r_t * (dc / s_c) * (dhh / s_h)))"},
    ]
