import random
import struct
import zlib

import numpy as np
import pytest

from kerbline.operators import mosaics
from kerbline.sources import png, snapshots

PASSES = png.PASSES


def filtered(rows, step, kinds):
    """Rows of bytes with the filters asked for, byte by byte."""
    out, before = b"", [0] * len(rows[0])
    for line, kind in zip(rows, kinds):
        line = [int(x) for x in line]
        out += bytes([kind])
        for i, x in enumerate(line):
            a, b, c = (line[i - step] if i >= step else 0), before[i], (before[i - step] if i >= step else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out += bytes([(x - (0, a, b, (a + b) // 2, paeth)[kind]) % 256])
        before = line
    return out


def picture(samples, colour, depth, interlaced, seed=0, palette=None):
    """A PNG of height x width x channels samples of `depth` bits, with filters drawn for each row."""
    draw = random.Random(seed)
    h, w, n = samples.shape
    body = b""
    for x0, y0, dx, dy in PASSES if interlaced else ((0, 0, 1, 1),):
        part = samples[y0::dy, x0::dx]
        if not part.size:
            continue
        if depth == 16:
            rows = part.astype(">u2").reshape(len(part), -1).view(np.uint8)
        elif depth == 8:
            rows = part.astype(np.uint8).reshape(len(part), -1)
        else:
            bits = (part.reshape(len(part), -1, 1) >> np.arange(depth - 1, -1, -1)) & 1
            rows = np.packbits(bits.reshape(len(part), -1).astype(np.uint8), axis=1)
        body += filtered(rows, max(1, n * depth // 8), [draw.randrange(5) for _ in rows])
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    extra = b"" if palette is None else chunk(b"PLTE", palette.tobytes())
    return png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, int(interlaced))) + extra + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize("colour, depth", [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 2), (3, 4), (3, 8), (4, 8), (4, 16), (6, 8), (6, 16)])
def test_every_kind_of_png(colour, depth, interlaced):
    draw = np.random.default_rng(colour * 100 + depth)
    palette = draw.integers(0, 256, (1 << min(depth, 8), 3), dtype=np.uint8) if colour == 3 else None
    for h, w in ((1, 1), (3, 2), (9, 13), (20, 7)):
        samples = draw.integers(0, 1 << depth, (h, w, png.CHANNELS[colour]))
        got = png.decode(picture(samples, colour, depth, interlaced, h, palette))
        if colour == 3:
            assert (got == palette[samples[..., 0]]).all()
        else:
            assert (got == (samples >> 8 if depth == 16 else samples * (255 // ((1 << min(depth, 8)) - 1)))).all()


def test_own_images_read_back_and_broken_ones_are_told():
    image = np.random.default_rng(1).integers(0, 256, (31, 17, 3), dtype=np.uint8)
    data = png.encode(image)
    assert (png.decode(data) == image).all() and (png.rgb(picture(image[..., :1].astype(int), 0, 8, False)) == image[..., :1]).all()
    for bad in (b"", b"GIF89a", data[:20], png.SIGNATURE):
        with pytest.raises((ValueError, struct.error, zlib.error)):
            png.decode(bad)


def plain_crop(tiles, cx, cy, half):
    out, filled = np.zeros((2 * half, 2 * half, 3), np.uint8), False
    for y in range(2 * half):
        for x in range(2 * half):
            gx, gy = cx - half + x, cy - half + y
            image = tiles.get((gx // 256, gy // 256))
            if image is not None:
                out[y, x], filled = image[gy % 256, gx % 256], True
    return out if filled else None


def test_crops_at_edges_and_corners(spark):
    draw = np.random.default_rng(4)
    images = {(x, y): draw.integers(0, 256, (256, 256, 3), dtype=np.uint8) for x, y in ((10, 20), (11, 20), (10, 21), (30, 30))}
    tiles = spark.createDataFrame([(x, y, bytearray(png.encode(i))) for (x, y), i in images.items()] + [(50, 50, bytearray(b"broken")), (60, 60, None)], "tile_x long, tile_y long, image binary")
    spots = [(2816, 5376), (2816, 5300), (2700, 5376), (2700, 5250), (2560, 5120), (7680, 7680), (7935, 7935), (40, 40), (12900, 12900), (15400, 15400), (2640, 5200), (2736, 5296)]
    sites = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(spots)] + [(90, None, 5), (91, 5, None)], "site long, cx long, cy long")
    got = {r["site"]: r for r in mosaics.crops(sites, tiles, 80).collect()}
    assert set(got) == {*range(len(spots)), 90, 91}
    for i, (x, y) in enumerate(spots):
        want = plain_crop(images, x, y, 80)
        if want is None:
            assert got[i]["image"] is None and got[i]["crc"] is None and got[i]["width"] is None
        else:
            assert (png.decode(bytes(got[i]["image"])) == want).all()
            assert (got[i]["width"], got[i]["height"], got[i]["crc"]) == (160, 160, zlib.crc32(want.tobytes()))
    assert got[90]["image"] is None and got[91]["crc"] is None


def test_many_sites_of_one_tile(spark):
    image = np.random.default_rng(5).integers(0, 256, (256, 256, 3), dtype=np.uint8)
    tiles = spark.createDataFrame([(0, 0, bytearray(png.encode(image)))], "tile_x long, tile_y long, image binary")
    sites = spark.range(500).selectExpr("id AS site", "20 + id % 200 AS cx", "20 + id * 7 % 200 AS cy")
    got = mosaics.crops(sites, tiles, 6).collect()
    assert len(got) == 500
    for r in got:
        x, y = 20 + r["site"] % 200, 20 + r["site"] * 7 % 200
        assert r["crc"] == zlib.crc32(image[y - 6 : y + 6, x - 6 : x + 6].tobytes())


def test_crops_become_files(spark, tmp_path):
    image = np.zeros((4, 4, 3), np.uint8)
    rows = spark.createDataFrame([(0, "2023", bytearray(png.encode(image))), (0, "2025", bytearray(png.encode(image + 9))), (1, "2023", None)], "place long, vintage string, image binary")
    snapshots.write_files(snapshots.crop_files(rows), str(tmp_path))
    got = {r["name"]: bytes(r["content"]) for r in snapshots.read_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"0_2023.png", "0_2025.png"} and (png.decode(got["0_2025.png"]) == 9).all()


def test_a_tile_is_decoded_once_for_all_its_sites(monkeypatch):
    import pyarrow as pa

    decoded, rgb = [], png.rgb
    monkeypatch.setattr(mosaics.png, "rgb", lambda data: decoded.append(1) or rgb(data))
    sites = [{"site": n, "cx": 20 + 30 * n, "cy": 40} for n in range(5)]
    rows = pa.RecordBatch.from_pylist([{"sites": sites, "tile_x": 0, "tile_y": 0, "image": png.encode(np.full((256, 256, 3), 7, np.uint8))}])
    assert sum(batch.num_rows for batch in mosaics._patches(12)(iter([rows]))) == 5 and len(decoded) == 1
