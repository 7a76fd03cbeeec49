"""Reports as text against texts written by hand, and missing lanes."""

from weftline.operators import report

COLOR = "struct<role:string,hex:string,usage:string,area:double,image_sourced:boolean,inferred:boolean>"
PALETTE = f"struct<provenance:string,colors:array<{COLOR}>,contrast:array<struct<fore:string,back:string,ratio:double,grade:string>>>"
SCHEMA = f"""capture_id int, kind string, ref string, captured_at string, palette {PALETTE}, palette_dark {PALETTE},
 typography struct<provenance:string,families:array<struct<name:string,role:string,classification:string,weights:array<int>,stack:array<string>>>,scale:array<struct<token:string,size:double,mobile:double,weight:int,line_height:string,letter_spacing:string>>>,
 spacing struct<provenance:string,base:double,scale:array<double>>, radius struct<provenance:string,scale:array<string>>, elevation struct<provenance:string,shadows:array<struct<name:string,value:string>>>,
 states struct<provenance:string,entries:array<struct<target:string,state:string,changes:array<struct<property:string,value:string>>>>>,
 motion struct<provenance:string,entries:array<struct<target:string,kind:string,property:string,duration:double,timing:string,delay:double,iterations:string>>,keyframes:array<struct<name:string,steps:array<struct<offset:string,properties:array<string>>>>>>,
 recipes struct<provenance:string,entries:array<struct<element:string,variant:string,bg:string,text:string,border:string,padding:string,radius:string,type_token:string,type_weight:int>>>,
 identity struct<provenance:string,archetype:string,description:string,adjectives:array<string>>, mood struct<provenance:string,hero:array<string>,texture:array<string>>"""
M = "measured"
FULL = (
    1, "design-system", "https://a.example", "2026-01-02",
    (M, [("primary", "#0055ff", "buttons", 0.125, False, False), (None, "#eeeeee", None, 0.5, True, True)], [("text", "background", 12.5, "AAA"), ("a", "b", 3.0, "fail")]), (M, [("background", "#000000", "", 1.0, None, None)], []),
    (M, [("Söhne Buch", "heading", "sans", [400, 700], ["Söhne Buch", "Arial"]), ("Inter", "heading", "sans", [400], [])], [("h1", 48.0, 32.0, 700, "1.1", "0"), ("body", 16.5, None, 400, "1.5", "normal")]),
    (M, 4.0, [4.0, 8.0, 10.5]), (M, ["4px", "9999px"]), (M, []),
    (M, [("button", "hover", [("color", "#fff"), ("opacity", "0.5")])]),
    (M, [("button", "transition", "color", 200.0, "ease", 50.0, None), ("x", "animation", "spin", 1500.0, "linear", 0.0, "infinite")], [("spin", [("0%", ["transform"]), ("100%", ["transform", "color"])])]),
    (M, [("button", "ghost", "primary", None, "", "8px 16px", "4px", "body", 600), ("input", None, None, "text", None, "4px", None, None, None)]),
    ("inferred", "Calm", "Quiet and plain.", ["soft", "airy"]), ("inferred", ["sea"], ["sand", "stone"]),
)
EMPTY = (2, "palette", "r", "t", (None, None, None), *(None,) * 10)
BODY = """# Design System

## Palette

- **primary** `#0055ff` — buttons · area 13%
- `#eeeeee` · area 50% · image-sourced · inferred

**Contrast**

- text on background: 12.5:1 (AAA)
- a on b: 3:1 (fail)

## Palette (dark scheme)

- **background** `#000000` · area 100%

## States

- **button** hover: `#fff` (text)
- **button** hover: `0.5` (opacity)

## Motion

- **button** `transition`: color 200ms ease · delay 50ms
- **x** `animation`: spin 1500ms linear · repeat infinite

**Keyframes**

- **@keyframes spin**: 0% [transform] → 100% [transform, color]

## Typography

**Families**

- **Söhne Buch** — heading, sans · weights 400, 700 · fallback: Arial — _suggested open alternative: Inter (Google Fonts)_
- **Inter** — heading, sans · weights 400

**Type scale**

| Token | Size | Recommended | Weight | Line height | Letter spacing |
|---|---|---|---|---|---|
| h1 | 48px (mobile 32px) | 48–64px | 700 | 1.1 | 0 |
| body | 16.5px | 16–18px | 400 | 1.5 | normal |

## Spacing

Base unit: `4px`

Scale (px): `[4, 8, 10.5]`

## Radius

Scale: `[4px, 9999px]`

## Component recipes

- **button (ghost)** — bg `primary` · padding 8px 16px · radius 4px · type `body`/600
- **input** — text `text` · padding 4px

## Identity _(inferred)_

**Calm**

Quiet and plain.

`soft` · `airy`

## Image mood _(inferred)_

Unsplash search keywords.

**Hero**

- sea

**Texture**

- sand
- stone

## CSS variables

```css
:root {
  --color-primary: #0055ff;
  --font-family: "Söhne Buch", Arial;
  --font-size-h1: 48px;
  --font-size-h1-mobile: 32px;
  --font-weight-h1: 700;
  --line-height-h1: 1.1;
  --letter-spacing-h1: 0;
  --font-size-body: 16.5px;
  --font-weight-body: 400;
  --line-height-body: 1.5;
  --letter-spacing-body: normal;
  --space-1: 4px;
  --space-2: 8px;
  --space-3: 10.5px;
  --radius-1: 4px;
  --radius-2: 9999px;
}

@media (prefers-color-scheme: dark) {
  :root {
    --color-background: #000000;
  }
}
```"""
THEME = """/* Generated by weftline from https://a.example (captured 2026-01-02). */
@theme {
  --color-primary: #0055ff;
  --font-heading: "Söhne Buch", Arial;
  --text-h1: 48px;
  --text-h1--line-height: 1.1;
  --text-h1--font-weight: 700;
  --text-h1--letter-spacing: 0;
  --text-body: 16.5px;
  --text-body--line-height: 1.5;
  --text-body--font-weight: 400;
  --text-body--letter-spacing: normal;
  --spacing: 4px;
  --radius-1: 4px;
  --radius-2: 9999px;
}

@media (prefers-color-scheme: dark) {
  :root {
    --color-background: #000000;
  }
}
"""


def test_full_and_missing_lanes(spark):
    full, empty = report.with_reports(spark.createDataFrame([FULL, EMPTY], SCHEMA)).orderBy("capture_id").collect()
    assert full["body"] == BODY
    assert full["theme"] == THEME
    assert empty["body"] == "# Palette & Mood\n\n## Palette\n\n\n## CSS variables\n\n```css\n:root {\n}\n```"
    assert empty["theme"] == "/* Generated by weftline from r (captured t). */\n@theme {\n}\n"


def test_elevation_and_widths(spark):
    from pyspark.sql import functions as F

    row = spark.sql("SELECT named_struct('provenance', 'measured', 'shadows', array(named_struct('name', 'sm', 'value', '0 1px 2px'))) AS e, map('1440', 'grid', '375', 'stack') AS w")
    got = row.select(report.elevation_text(F.col("e")), report.responsive_text(F.lit("Card"), F.col("w"))).first()
    assert tuple(got) == ("## Elevation\n\nShadows:\n\n- **sm** `0 1px 2px`", "- **Card** — 375px `stack` → 1440px `grid`")
