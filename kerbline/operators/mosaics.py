"""Crops of aerial imagery about sites, put together from the tiles under them.

Sites are gathered by the tiles under their windows, up to some thousand in a row, and these rows meet tiles by an equi-join on tile keys, so
adaptive execution can split a tile with very many sites. A row's tile is decoded once, and only the patches that lie in windows go on; the patches of
a site, as many as tiles under it, are joined and placed. Pixels of missing or unreadable tiles stay black; a site without any tile has no crop.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions.geo import num
from kerbline.sources import png

TILE = 256
#: Sites that are read from one decoding of a tile, about.
SITES = 4096


def pixel_of(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of a point among all pixels of a zoom level."""
    n = num(2.0**zoom * TILE)
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.asinh(F.tan(F.radians(lat))) / num(math.pi)) / 2 * n)
    return x.cast("bigint"), y.cast("bigint")


def windows(sites: DataFrame, half: int) -> DataFrame:
    """site, cx, cy and a row for each tile (tile_x, tile_y) under the window of 2 * half pixels about (cx, cy)."""
    span = lambda c: F.sequence(F.floor((F.col(c) - half) / TILE).cast("bigint"), F.floor((F.col(c) + half - 1) / TILE).cast("bigint"))
    return sites.select("site", "cx", "cy", F.explode(span("cx")).alias("tile_x")).select("*", F.explode(span("cy")).alias("tile_y"))


_PATCH = "site long, dx int, dy int, width int, height int, pixels binary"


def _patches(half: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (row for batch in batches for part in range(batch.num_rows) for row in batch.slice(part, 1).to_pylist()):
            out = []
            try:
                image = png.rgb(row["image"] or b"")
            except (ValueError, zlib.error, struct.error):
                continue
            for site in row["sites"]:
                row |= site
                x0, y0 = row["cx"] - half, row["cy"] - half  # the window's corner, and the overlap with this tile
                left, top = max(x0, row["tile_x"] * TILE), max(y0, row["tile_y"] * TILE)
                right = min(row["cx"] + half, row["tile_x"] * TILE + min(TILE, image.shape[1]))
                low = min(row["cy"] + half, row["tile_y"] * TILE + min(TILE, image.shape[0]))
                if left < right and top < low:
                    part = image[top - row["tile_y"] * TILE : low - row["tile_y"] * TILE, left - row["tile_x"] * TILE : right - row["tile_x"] * TILE]
                    out.append({"site": row["site"], "dx": left - x0, "dy": top - y0, "width": right - left, "height": low - top, "pixels": part.tobytes()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("site", pa.int64()), *((c, pa.int32()) for c in ("dx", "dy", "width", "height")), ("pixels", pa.binary())]))

    return run


def _placed(half: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images, sums = [], []
            for parts in batch.column(1).to_pylist():
                if not parts:
                    images.append(None), sums.append(None)
                    continue
                out = np.zeros((2 * half, 2 * half, 3), np.uint8)
                for p in parts:
                    out[p["dy"] : p["dy"] + p["height"], p["dx"] : p["dx"] + p["width"]] = np.frombuffer(p["pixels"], np.uint8).reshape(p["height"], p["width"], 3)
                images.append(png.encode(out))
                sums.append(zlib.crc32(out.tobytes()))
            sizes = pa.array([None if i is None else 2 * half for i in images], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, sizes, pa.array(sums, pa.int64()), pa.array(images, pa.binary())], ["site", "width", "height", "crc", "image"])

    return run


def crops(sites: DataFrame, tiles: DataFrame, half: int = 80) -> DataFrame:
    """site, width, height, crc (CRC-32 of the pixels, row by row, as red, green, blue) and image (PNG) of every site.

    sites: site, cx, cy (pixel_of; each site once). tiles: tile_x, tile_y, image (PNG bytes; each tile once). Sites without a place or a tile have
    a row of nulls.
    """
    asked = sites.select(F.col("site").cast("bigint").alias("site"), "cx", "cy")
    under = windows(asked.where("cx IS NOT NULL AND cy IS NOT NULL"), half)
    per = under.groupBy("tile_x", "tile_y").agg(F.ceil(F.count("*") / SITES).alias("rows"))
    dealt = under.join(per, ["tile_x", "tile_y"]).groupBy("tile_x", "tile_y", F.pmod(F.xxhash64("site"), "rows").alias("row")).agg(F.collect_list(F.struct("site", "cx", "cy")).alias("sites"))
    met = dealt.join(tiles.select("tile_x", "tile_y", "image").hint("merge"), ["tile_x", "tile_y"])
    patches = met.select("sites", "tile_x", "tile_y", "image").mapInArrow(_patches(half), _PATCH)
    parts = patches.groupBy("site").agg(F.collect_list(F.struct("dx", "dy", "width", "height", "pixels")).alias("parts"))
    whole = asked.select("site").join(parts, "site", "left").select("site", "parts")
    return whole.mapInArrow(_placed(half), "site long, width int, height int, crc long, image binary")
