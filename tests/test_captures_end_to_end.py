"""From capture files to palettes and scales, and screenshots against an encoder of every filter."""

import base64
import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.plans import registry
from weftline.sources import captures
from weftline.sources import observations as O


def chunk(name, body):
    return struct.pack(">I4s", len(body), name) + body + struct.pack(">I", zlib.crc32(name + body))


def png(pixels, kind, filters, palette=b"", clear=b""):
    """A PNG of (height, width, channels); filters gives the filter of each line."""
    h, w, step = pixels.shape
    out, above = [], [0] * (w * step)
    for y in range(h):
        line, f = pixels[y].reshape(-1).tolist(), filters[y % len(filters)]
        coded = []
        for k, x in enumerate(line):
            a, b, c = (line[k - step] if k >= step else 0), above[k], (above[k - step] if k >= step else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            coded.append((x - (0, a, b, (a + b) // 2, paeth)[f]) % 256)
        out.append(bytes([f, *coded]))
        above = line
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0))
    return O.SIGNATURE + head + (chunk(b"PLTE", palette) if palette else b"") + (chunk(b"tRNS", clear) if clear else b"") + chunk(b"IDAT", zlib.compress(b"".join(out))) + chunk(b"IEND", b"")


def test_png():
    rng = np.random.default_rng(1)
    for kind, step in O.CHANNELS.items():
        pixels = rng.integers(0, 4 if kind == 3 else 256, (11, 7, step), np.uint8)
        palette = bytes(range(12)) if kind == 3 else b""
        data = png(pixels, kind, (0, 1, 2, 3, 4), palette, b"\x07" if kind == 3 else b"")
        got = O.decode_png(data)
        assert got.shape == (11, 7, 4) and O.image_size(data) == (7, 11)
        if kind == 3:
            assert (got[..., :3] == np.arange(12, dtype=np.uint8).reshape(4, 3)[pixels[..., 0]]).all() and (got[..., 3] == np.where(pixels[..., 0] == 0, 7, 255)).all()
        else:
            assert (got[..., 0] == pixels[..., 0]).all() and (got[..., 2] == pixels[..., 2 if step > 2 else 0]).all() and (got[..., 3] == (pixels[..., -1] if kind in (4, 6) else 255)).all()
        cut = random.Random(kind)
        assert all(O.decode_png(data[: cut.randrange(len(data) - 16)]) is None for _ in range(20))
    assert O.decode_png(b"") is None and O.decode_png(b"\xff\xd8") is None
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc2\x00\x11\x08" + struct.pack(">HH", 30, 40) + b"\x03" * 9
    webp = b"RIFF\0\0\0\0WEBPVP8X\0\0\0\0\0\0\0\0" + (39).to_bytes(3, "little") + (29).to_bytes(3, "little")
    assert [O.image_size(x) for x in (jpeg, webp, b"GIF89a" + struct.pack("<HH", 40, 30), b"junk", b"", None, jpeg[:9], O.SIGNATURE)] == [(40, 30)] * 3 + [None] * 5


def node(tag, size=None, **more):
    kind = {"fontFamily": '"Inter", sans-serif', "fontSizePx": size, "fontWeight": 400, "lineHeightPx": size * 1.5, "letterSpacing": "normal"} if size else None
    layout = {"marginsPx": more.get("space", []), "paddingsPx": [], "gapsPx": [], "borderRadius": more.get("radius", ""), "boxShadow": more.get("shadow", "")}
    out = {"tag": tag, "rect": {"x": 0, "y": 0, "w": 10, "h": 10}, "colors": [{"channel": c, "value": v} for c, v in more.get("colors", {}).items()], "hasText": bool(size), "interactive": tag == "A", "layout": layout}
    return out | ({"type": kind} if kind else {}) | ({"states": more["states"]} if "states" in more else {})


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    ink, paper, blue = "rgb(20, 20, 20)", "#fff", "rgba(20, 60, 220, 1)"
    nodes = [node("BODY", 16, colors={"background": paper, "text": ink}, space=[8, 16, 16, 24, 8])]
    nodes += [node("P", 16, colors={"text": ink}, space=[24]) for _ in range(8)]
    nodes += [node("H1", 40, colors={"text": ink}), node("H2", 28, colors={"text": ink}), node("SMALL", 12, colors={"text": "not a colour"})]
    nodes += [node("A", 16, colors={"background": blue, "text": paper}, radius="8px", shadow="0px 1px 2px red", states=[{"state": "hover", "changes": [{"property": "color", "from": paper, "to": "#000"}]}]) for _ in range(3)]
    image = np.full((20, 30, 3), 255, np.uint8)
    image[:5] = (20, 60, 220)
    shot = base64.b64encode(png(image, 2, (4,))).decode()
    site = {"source": {"type": "url", "ref": "https://a.example"}, "styleDump": {"nodes": nodes}, "viewportShot": shot}
    for name, body in (("one", json.dumps(site)), ("bare", json.dumps({"styleDump": {"nodes": []}, "viewportShot": "????"})), ("broken", "{")):
        (folder / name).mkdir()
        (folder / name / "capture.json").write_text(body)
    return captures.read(spark, f"{folder}/*/capture.json")


def test_scales_of_captures(spark, read):
    seen = O.observations(captures.style_nodes(read).filter("scheme = 'light'"))
    rows = lambda name: registry.run(spark, name, seen).collect()
    assert [(r.capture_id, r.base_unit_px, sorted(r.scale.split(), key=int)) for r in rows("d12_spacing_scale")] == [("one", 8, ["8", "16", "24"])]
    assert {(r.token, r.size, r.weight, r.line_height) for r in rows("d9_type_scale")} == {("h2", 40, 400, 1.5), ("h3", 28, 400, 1.5), ("body", 16, 400, 1.5), ("small", 12, 400, 1.5)}
    assert [(r.family, r.role) for r in rows("d11_font_families")] == [("Inter", "body")]
    assert [r.scale for r in rows("d13_radius_scale")] == ["8px"] and [(r.name, r.magnitude) for r in rows("d14_elevation")] == [("sm", 3.0)]


def test_palette_of_captures(spark, read):
    nodes = captures.style_nodes(read).filter("scheme = 'light'")
    shots = read.select(F.col("slug").alias("capture_id"), F.col("viewportShot").alias("png"))
    assert sorted((r.capture_id, r.r, r.g, r.b, r.n, r.first_ix) for r in O.pixel_hist(shots).collect()) == [("one", 20, 60, 220, 150, 0), ("one", 255, 255, 255, 450, 150)]
    got = registry.run(spark, "h7_palette_roles", O.observations(nodes, shots)).collect()
    by_role = {r.role: (r.hex, r.area_weight) for r in got}
    assert {r.capture_id for r in got} == {"one"}
    assert by_role["background"] == ("#ffffff", 0.75) and by_role["text"][0] == "#141414" and by_role["surface"] == ("#143cdc", 0.25)
    assert "primary" not in by_role  # the surface is picked first and leaves no colour with chroma
