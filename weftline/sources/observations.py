"""Relations that the palette, typography and token plans read, from style nodes and screenshots of captures.

`registry.run(spark, name, observations(nodes, shots))` runs a plan over captures; its capture_id has the captures' own type.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.attribution import channels

from .shared import ship

#: Places of a node's values in document order: a node holds fewer values of one sort than this.
STEP = 4096
#: Channels by PNG colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def color_obs(nodes: DataFrame) -> DataFrame:
    """Every colour of every node: capture_id, ord, channel, interactive, semantic, r, g, b; what is no colour is left out."""
    rows = nodes.select("capture_id", "ord", "interactive", "semanticContext", F.posexplode("colors").alias("at", "c"))
    rows = rows.withColumn("rgb", channels(F.col("c.value"))).filter("rgb IS NOT NULL")
    parts = [F.floor(F.col(f"rgb.{x}") + 0.5).cast("int").alias(x) for x in "rgb"]
    return rows.select("capture_id", _place(), F.col("c.channel").alias("channel"), F.coalesce("interactive", F.lit(False)).alias("interactive"), F.col("semanticContext").isNotNull().alias("semantic"), *parts)


def _place() -> Column:
    return (F.col("ord").cast("long") * STEP + F.col("at")).alias("ord")


def type_samples(nodes: DataFrame) -> DataFrame:
    """Type of the nodes that have text of their own."""
    rows = nodes.filter("hasText AND type IS NOT NULL AND type.fontSizePx IS NOT NULL")
    return rows.select(
        "capture_id", F.col("ord").cast("long").alias("ord"), F.col("type.fontSizePx").alias("size_px"), F.col("type.fontWeight").cast("int").alias("weight"), F.col("type.lineHeightPx").alias("line_height_px"),
        F.coalesce("type.fontFamily", F.lit("")).alias("font_family"), F.lower("tag").alias("tag"), F.coalesce("type.letterSpacing", F.lit("normal")).alias("letter_spacing"),
    )


def spacing_obs(nodes: DataFrame) -> DataFrame:
    """Margins, paddings and gaps of every node, rounded, of more than 0 and at most 256 px."""
    none = F.array().cast("array<double>")
    every = F.concat(*(F.coalesce(f"layout.{f}", none) for f in ("marginsPx", "paddingsPx", "gapsPx")))
    rows = nodes.select("capture_id", "ord", F.posexplode(every).alias("at", "raw")).withColumn("px", F.floor(F.col("raw") + 0.5).cast("int"))
    return rows.filter("px BETWEEN 1 AND 256").select("capture_id", _place(), "px")


def css_obs(nodes: DataFrame) -> DataFrame:
    """Radius and shadow of every node with a layout; an empty radius is 0px."""
    rows = nodes.filter("layout IS NOT NULL")
    radius = F.coalesce(F.nullif(F.trim("layout.borderRadius"), F.lit("")), F.lit("0px"))
    return rows.select("capture_id", F.col("ord").cast("long").alias("ord"), radius.alias("radius"), F.coalesce("layout.boxShadow", F.lit("")).alias("shadow"))


def unfiltered(kind: int, line, above, step: int):
    """A scan line of a PNG without its filter; `above` is the line before, unfiltered."""
    import numpy as np

    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    if kind == 2:
        return line + above
    out, up = [0] * step + line.tolist(), [0] * step + above.tolist()
    for k in range(step, len(out)):
        a, b, c = out[k - step], up[k], up[k - step]
        if kind == 3:
            guess = (a + b) // 2
        else:
            p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if p <= q and p <= r else b if q <= r else c
        out[k] = (out[k] + guess) & 255
    return np.array(out[step:], np.uint8)


def decode_png(data: bytes):
    """A10: (height, width, 4) bytes of a PNG of 8 bits a channel without interlacing; None for anything else, cut files included."""
    import numpy as np

    try:
        if data[:8] != SIGNATURE:
            return None
        at, idat, palette, clear = 8, [], None, b""
        width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", data[16:29])
        if depth != 8 or interlaced or kind not in CHANNELS:
            return None
        while at + 8 <= len(data):
            size, name = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + size]
            if name == b"IDAT":
                idat.append(body)
            elif name == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif name == b"tRNS":
                clear = body
            at += size + 12
        step = CHANNELS[kind]
        raw = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8).reshape(height, 1 + width * step)
        lines, above = np.empty((height, width * step), np.uint8), np.zeros(width * step, np.uint8)
        for y in range(height):
            lines[y] = above = unfiltered(int(raw[y, 0]), raw[y, 1:], above, step)
        pixels = lines.reshape(height, width, step)
        out = np.full((height, width, 4), 255, np.uint8)
        if kind == 3:
            out[..., :3] = palette[pixels[..., 0]]
            alpha = np.full(256, 255, np.uint8)
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
            out[..., 3] = alpha[pixels[..., 0]]
        elif kind in (0, 4):
            out[..., :3] = pixels[..., :1]
            out[..., 3] = pixels[..., 1] if kind == 4 else 255
        else:
            out[..., :step] = pixels
        return out
    except (struct.error, zlib.error, ValueError, IndexError, TypeError):
        return None


def pixel_hist(shots: DataFrame) -> DataFrame:
    """A10, G1: capture_id, r, g, b, n, first_ix of the colours of a capture's screenshots (capture_id, png in base64).

    Alpha is not looked at. A picture is decoded by one task and leaves as its distinct colours; pictures that cannot be read give
    none, as do nulls. Pictures keep their size: no resampling can be reproduced exactly, and shares hardly change with it.
    """
    kind = shots.schema["capture_id"].dataType.simpleString()
    ship(shots.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import base64
        import binascii

        import numpy as np
        import pandas as pd

        for batch in batches:
            for key, text in zip(batch["capture_id"], batch["png"], strict=True):
                try:
                    image = decode_png(base64.b64decode(text or ""))
                except (binascii.Error, ValueError):
                    image = None
                if image is None or not image.size:
                    continue
                flat = image.reshape(-1, 4).astype(np.int32)
                codes, first, counts = np.unique(flat[:, 0] << 16 | flat[:, 1] << 8 | flat[:, 2], return_index=True, return_counts=True)
                yield pd.DataFrame({"capture_id": [key] * len(codes), "r": codes >> 16, "g": codes >> 8 & 255, "b": codes & 255, "n": counts.astype(np.int64), "first_ix": first.astype(np.int64)})

    rows = shots.select("capture_id", "png").filter("png IS NOT NULL").mapInPandas(run, f"capture_id {kind}, r int, g int, b int, n long, first_ix long")
    return rows.groupBy("capture_id", "r", "g", "b").agg(F.sum("n").alias("n"), F.min("first_ix").alias("first_ix"))


def image_size(data: bytes | None) -> tuple[int, int] | None:
    """(width, height) from the header of a PNG, GIF, WebP or JPEG; None where it cannot be read."""
    data = data or b""
    try:
        if data[:8] == SIGNATURE:
            return struct.unpack(">II", data[16:24])
        if data[:4] == b"GIF8":
            return struct.unpack("<HH", data[6:10])
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            if data[12:16] == b"VP8X":
                return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
            if data[12:16] == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
            w, h = struct.unpack("<HH", data[26:30])
            return w & 0x3FFF, h & 0x3FFF
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 <= len(data):
                mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
                if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return w, h
                at += 2 + size
    except struct.error:
        pass
    return None


def observations(nodes: DataFrame, shots: DataFrame | None = None) -> dict[str, DataFrame]:
    """The relations of plans by name; with shots, areas of colours come from pixels."""
    out = {f.__name__: f(nodes) for f in (color_obs, type_samples, spacing_obs, css_obs)}
    return out if shots is None else out | {"pixel_hist": pixel_hist(shots)}
