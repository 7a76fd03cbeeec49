"""Reports of captures as text. Each function takes a lane, a struct column, and gives one string column; a missing lane gives null.

Nothing is collected: a capture is one row, and a lane holds what one report shows. A null list counts as empty, a null or empty
optional field is left out, and order and repeated entries are kept. Frames may have further columns; `with_reports` adds its own.
Lanes and their fields:

palette, palette_dark  provenance, colors (role, hex, usage, area, image_sourced, inferred), contrast (fore, back, ratio, grade)
typography  provenance, families (name, role, classification, weights, stack), scale (token, size, mobile, weight, line_height, letter_spacing)
spacing  provenance, base, scale;  radius  provenance, scale (texts);  elevation  provenance, shadows (name, value)
states  provenance, entries (target, state, changes (property, value))
motion  provenance, entries (target, kind, property, duration, timing, delay, iterations), keyframes (name, steps (offset, properties))
recipes  provenance, entries (element, variant, bg, text, border, padding, radius, type_token, type_weight)
identity  provenance, archetype, description, adjectives;  mood  provenance, hero, texture
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.styles import css_font, font_substitute, percent

# Conventional sizes by token, labels of state properties, titles by kind of report.
TYPE_RANGES = {"display": "64–96px", "h1": "48–64px", "h2": "32–40px", "h3": "24–28px", "body": "16–18px", "small": "14px"}
STATE_LABELS = {"background-color": "background", "color": "text", "border-color": "border", "box-shadow": "shadow"}
TITLES = {"design-system": "Design System", "other": "Palette & Mood"}

LANES = ("palette", "palette_dark", "states", "motion", "typography", "spacing", "radius", "elevation", "recipes", "identity", "mood")


def number_text(x: Column) -> Column:
    """A number without an empty fraction; exact to ten decimals."""
    return F.when(x == 0, "0").otherwise(F.regexp_replace(x.cast("double").cast("decimal(38,10)").cast("string"), r"\.?0+$", ""))


def optional(value: Column, before: str = "", after: str = "") -> Column:
    """The text between its marks, or nothing where it is null or empty."""
    return F.when(F.coalesce(value, F.lit("")) == "", "").otherwise(F.concat(F.lit(before), value, F.lit(after)))


def each(items: Column, line) -> Column:
    """A line per item."""
    return F.coalesce(F.transform(items, line), F.array().cast("array<string>"))


def fixed(*texts: str) -> Column:
    return F.array(*map(F.lit, texts)).cast("array<string>")


def when_any(items: Column, lines: Column) -> Column:
    return F.when(F.size(F.coalesce(items, F.array())) > 0, lines).otherwise(F.array().cast("array<string>"))


def section(lane: Column, title: str, *lines: Column) -> Column:
    """Heading, with the provenance where it is not measured, an empty line, and the lines."""
    made = F.coalesce(lane["provenance"], F.lit("measured"))
    heading = F.concat(F.lit(f"## {title}"), F.when(made == "measured", "").otherwise(F.concat(F.lit(" _("), made, F.lit(")_"))))
    return F.when(lane.isNotNull(), F.array_join(F.concat(F.array(heading, F.lit("")), *lines), "\n"))


def by_value(key: Column, values: dict[str, str], default: Column) -> Column:
    out = default
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def palette_text(lane: Column, title: str = "Palette") -> Column:
    """K3."""

    def color(c):
        name = F.concat(optional(c["role"], "**", "** "), F.lit("`"), c["hex"], F.lit("`"))
        area = F.concat(F.lit(" · area "), percent(F.coalesce(c["area"], F.lit(0.0))))
        marks = F.concat(F.when(c["image_sourced"], " · image-sourced").otherwise(""), F.when(c["inferred"], " · inferred").otherwise(""))
        return F.concat(F.lit("- "), name, optional(c["usage"], " — "), area, marks)

    pair = lambda p: F.concat(F.lit("- "), p["fore"], F.lit(" on "), p["back"], F.lit(": "), number_text(p["ratio"]), F.lit(":1 ("), p["grade"], F.lit(")"))
    contrast = F.concat(fixed("", "**Contrast**", ""), each(lane["contrast"], pair))
    return section(lane, title, each(lane["colors"], color), when_any(lane["contrast"], contrast))


def typography_text(lane: Column) -> Column:
    """K4: families with open substitutes, and the scale beside conventional ranges."""

    def family(f):
        others = F.array_join(F.filter(F.coalesce(f["stack"], F.array().cast("array<string>")), lambda n: n != f["name"]), ", ")
        weights = F.array_join(F.transform(f["weights"], number_text), ", ")
        about = F.concat(F.lit("** — "), f["role"], F.lit(", "), f["classification"], F.lit(" · weights "), F.coalesce(weights, F.lit("")))
        return F.concat(F.lit("- **"), f["name"], about, optional(others, " · fallback: "), optional(font_substitute(f["name"]), " — _suggested open alternative: ", " (Google Fonts)_"))

    def step(s):
        size = F.concat(number_text(s["size"]), F.lit("px"), F.when(s["mobile"] != 0, F.concat(F.lit(" (mobile "), number_text(s["mobile"]), F.lit("px)"))).otherwise(""))
        cells = F.array(s["token"], size, by_value(s["token"], TYPE_RANGES, F.lit("")), number_text(s["weight"]), s["line_height"], s["letter_spacing"])
        return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda x: F.coalesce(x, F.lit(""))), " | "), F.lit(" |"))

    table = fixed("", "**Type scale**", "", "| Token | Size | Recommended | Weight | Line height | Letter spacing |", "|---|---|---|---|---|---|")
    return section(lane, "Typography", fixed("**Families**", ""), each(lane["families"], family), table, each(lane["scale"], step))


def joined(items: Column, text=lambda x: x) -> Column:
    return F.coalesce(F.array_join(F.transform(items, text), ", "), F.lit(""))


def spacing_text(lane: Column) -> Column:
    """K5."""
    base = F.concat(F.lit("Base unit: `"), number_text(lane["base"]), F.lit("px`"))
    return section(lane, "Spacing", F.array(base, F.lit(""), F.concat(F.lit("Scale (px): `["), joined(lane["scale"], number_text), F.lit("]`"))))


def radius_text(lane: Column) -> Column:
    """K5."""
    return section(lane, "Radius", F.array(F.concat(F.lit("Scale: `["), joined(lane["scale"]), F.lit("]`"))))


def elevation_text(lane: Column) -> Column:
    """K5: null without shadows."""
    shadow = lambda s: F.concat(F.lit("- **"), s["name"], F.lit("** `"), s["value"], F.lit("`"))
    return F.when(F.size(lane["shadows"]) > 0, section(lane, "Elevation", fixed("Shadows:", ""), each(lane["shadows"], shadow)))


def states_text(lane: Column) -> Column:
    """K6: a line per change."""
    line = lambda e, c: F.concat(F.lit("- **"), e["target"], F.lit("** "), e["state"], F.lit(": `"), c["value"], F.lit("` ("), by_value(c["property"], STATE_LABELS, c["property"]), F.lit(")"))
    return section(lane, "States", F.flatten(F.coalesce(F.transform(lane["entries"], lambda e: each(e["changes"], lambda c: line(e, c))), F.array(F.array().cast("array<string>")))))


def motion_text(lane: Column) -> Column:
    """K6, with the keyframes."""

    def entry(e):
        delay = F.when(e["delay"] != 0, F.concat(F.lit(" · delay "), number_text(e["delay"]), F.lit("ms"))).otherwise("")
        what = F.concat(F.lit("- **"), e["target"], F.lit("** `"), e["kind"], F.lit("`: "), e["property"], F.lit(" "))
        return F.concat(what, number_text(e["duration"]), F.lit("ms "), e["timing"], delay, optional(e["iterations"], " · repeat "))

    stop = lambda s: F.concat(s["offset"], F.lit(" ["), joined(s["properties"]), F.lit("]"))
    frame = lambda k: F.concat(F.lit("- **@keyframes "), k["name"], F.lit("**: "), F.coalesce(F.array_join(F.transform(k["steps"], stop), " → "), F.lit("")))
    return section(lane, "Motion", each(lane["entries"], entry), when_any(lane["keyframes"], F.concat(fixed("", "**Keyframes**", ""), each(lane["keyframes"], frame))))


def recipes_text(lane: Column) -> Column:
    """K6: only the measured parts of a recipe."""

    def entry(e):
        part = lambda name: F.nullif(optional(e[name], f"{name} `", "`"), F.lit(""))
        weight = F.when(e["type_weight"] != 0, F.concat(F.lit("/"), number_text(e["type_weight"]))).otherwise("")
        kind = F.when(F.coalesce(e["type_token"], F.lit("")) != "", F.concat(F.lit("type `"), e["type_token"], F.lit("`"), weight))
        parts = F.array_compact(F.array(part("bg"), part("text"), part("border"), F.concat(F.lit("padding "), F.coalesce(e["padding"], F.lit(""))), F.nullif(optional(e["radius"], "radius "), F.lit("")), kind))
        return F.concat(F.lit("- **"), e["element"], optional(e["variant"], " (", ")"), F.lit("** — "), F.array_join(parts, " · "))

    return section(lane, "Component recipes", each(lane["entries"], entry))


def identity_text(lane: Column) -> Column:
    """K7."""
    words = F.coalesce(F.array_join(F.transform(lane["adjectives"], lambda a: F.concat(F.lit("`"), a, F.lit("`"))), " · "), F.lit(""))
    return section(lane, "Identity", F.array(F.concat(F.lit("**"), lane["archetype"], F.lit("**")), F.lit(""), lane["description"], F.lit(""), words))


def mood_text(lane: Column) -> Column:
    """K7."""
    item = lambda q: F.concat(F.lit("- "), q)
    return section(lane, "Image mood", fixed("Unsplash search keywords.", "", "**Hero**", ""), each(lane["hero"], item), fixed("", "**Texture**", ""), each(lane["texture"], item))


def declared(prefix: str, value: Column, unit: str = "", indent: str = "  ") -> Column:
    """One custom property; prefix is a text or a column."""
    name = prefix if isinstance(prefix, Column) else F.lit(prefix)
    return F.concat(F.lit(f"{indent}--"), name, F.lit(": "), value, F.lit(f"{unit};"))


def color_lines(lane: Column, indent: str = "  ") -> Column:
    roled = F.filter(lane["colors"], lambda c: F.coalesce(c["role"], F.lit("")) != "")
    return each(roled, lambda c: declared(F.concat(F.lit("color-"), c["role"]), c["hex"], indent=indent))


def dark_lines(lane: Column) -> Column:
    return when_any(lane["colors"], F.concat(fixed("", "@media (prefers-color-scheme: dark) {", "  :root {"), color_lines(lane, "    "), fixed("  }", "}")))


def family_stack(f: Column) -> Column:
    return F.array_join(F.transform(F.when(F.size(f["stack"]) > 0, f["stack"]).otherwise(F.array(f["name"])), css_font), ", ")


def numbered(items: Column, name: str, text=lambda x: x, unit: str = "") -> Column:
    return F.coalesce(F.transform(items, lambda x, i: declared(F.concat(F.lit(f"{name}-"), (i + 1).cast("string")), text(x), unit)), F.array().cast("array<string>"))


def shadow_lines(lane: Column) -> Column:
    return each(lane["shadows"], lambda s: declared(F.concat(F.lit("shadow-"), s["name"]), s["value"]))


def css_text(r: dict[str, Column]) -> Column:
    """K8: custom properties of every lane, those of the dark scheme in a media block."""

    def step(s):
        of = lambda name, value, unit="", end="": declared(F.concat(F.lit(f"{name}-"), s["token"], F.lit(end)), value, unit)
        mobile = F.when(s["mobile"] != 0, of("font-size", number_text(s["mobile"]), "px", "-mobile"))
        return F.array_compact(F.array(of("font-size", number_text(s["size"]), "px"), mobile, of("font-weight", number_text(s["weight"])), of("line-height", s["line_height"]), of("letter-spacing", s["letter_spacing"])))

    none = F.array().cast("array<string>")
    first = F.get(r["typography"]["families"], F.lit(0))
    lines = F.concat(
        fixed("## CSS variables", "", "```css", ":root {"), color_lines(r["palette"]),
        F.when(first.isNotNull(), F.array(declared("font-family", family_stack(first)))).otherwise(none),
        F.coalesce(F.flatten(F.transform(r["typography"]["scale"], step)), none),
        numbered(r["spacing"]["scale"], "space", number_text, "px"), numbered(r["radius"]["scale"], "radius"), shadow_lines(r["elevation"]),
        fixed("}"), dark_lines(r["palette_dark"]), fixed("```"),
    )
    return F.array_join(lines, "\n")


def theme_text(r: dict[str, Column], ref: Column, captured_at: Column) -> Column:
    """K9: a theme block; of the families of one role the first counts. The comment at the top names this engine."""

    def step(s):
        of = lambda end, value, unit="": declared(F.concat(F.lit("text-"), s["token"], F.lit(end)), value, unit)
        return F.array(of("", number_text(s["size"]), "px"), of("--line-height", s["line_height"]), of("--font-weight", number_text(s["weight"])), of("--letter-spacing", s["letter_spacing"]))

    none = F.array().cast("array<string>")
    families = r["typography"]["families"]
    roles = F.transform(families, lambda f: f["role"])
    firsts = F.filter(families, lambda f, i: F.array_position(roles, f["role"]) == i + 1)
    lines = F.concat(
        F.array(F.concat(F.lit("/* Generated by weftline from "), ref, F.lit(" (captured "), captured_at, F.lit("). */")), F.lit("@theme {")),
        color_lines(r["palette"]), each(firsts, lambda f: declared(F.concat(F.lit("font-"), f["role"]), family_stack(f))),
        F.coalesce(F.flatten(F.transform(r["typography"]["scale"], step)), none),
        F.when(r["spacing"].isNotNull(), F.array(declared("spacing", number_text(r["spacing"]["base"]), "px"))).otherwise(none),
        numbered(r["radius"]["scale"], "radius"), shadow_lines(r["elevation"]), fixed("}"), dark_lines(r["palette_dark"]), fixed(""),
    )
    return F.array_join(lines, "\n")


def responsive_text(name: Column, by_width: Column) -> Column:
    """The annotations of a component by width, the narrowest first. by_width: map of a width to a text."""
    entries = F.array_sort(F.transform(F.map_entries(by_width), lambda e: F.struct(e["key"].cast("int").alias("w"), e["value"].alias("a"))))
    return F.concat(F.lit("- **"), name, F.lit("** — "), F.array_join(F.transform(entries, lambda e: F.concat(e["w"].cast("string"), F.lit("px `"), e["a"], F.lit("`"))), " → "))


def body_text(r: dict[str, Column], kind: Column) -> Column:
    """The sections of a report in their order; lanes that are null are left out."""
    title = F.concat(F.lit("# "), F.when(kind == "design-system", TITLES["design-system"]).otherwise(TITLES["other"]))
    parts = [
        title, palette_text(r["palette"]), palette_text(r["palette_dark"], "Palette (dark scheme)"), states_text(r["states"]), motion_text(r["motion"]), typography_text(r["typography"]),
        spacing_text(r["spacing"]), radius_text(r["radius"]), elevation_text(r["elevation"]), recipes_text(r["recipes"]), identity_text(r["identity"]), mood_text(r["mood"]), css_text(r),
    ]
    return F.concat_ws("\n\n", *parts)


def with_reports(captures: DataFrame) -> DataFrame:
    """The columns `body` and `theme` for a frame with kind, ref, captured_at and the LANES."""
    r = {lane: F.col(lane) for lane in LANES}
    return captures.withColumns({"body": body_text(r, F.col("kind")), "theme": theme_text(r, F.col("ref"), F.col("captured_at"))})
