"""Colours and verdicts of aerial imagery as column expressions over pixels or sites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbline.functions.geo import num

# Paint colours, and the differences between two years that count.
GREEN_HUE, GREEN_SATURATION, GREEN_VALUE = (128.0, 178.0), 0.30, (0.28, 0.90)
WHITE_SATURATION, WHITE_VALUE = 0.22, 0.68
GREEN_PRESENT, WHITE_PRESENT, GREEN_DELTA, WHITE_DELTA, DARK, GLARE = 0.015, 0.015, 0.040, 0.220, 0.18, 0.45
PAINTED = ("separated", "buffered", "lane")


def elevation_of(r: Column, g: Column, b: Column) -> Column:
    """Metres of a terrain tile's pixel."""
    return r * 256 + g + b / 256 - 32768


def _hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    r, g, b = r / num(255), g / num(255), b / num(255)
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    c = F.nullif(top - low, num(0))
    hue = F.when(top == r, F.pmod((g - b) / c, num(6))).when(top == g, (b - r) / c + 2).otherwise((r - g) / c + 4) * 60
    return F.coalesce(hue, num(0)), F.when(top > 0, (top - low) / top).otherwise(num(0)), top


def is_green_paint(r: Column, g: Column, b: Column) -> Column:
    h, s, v = _hsv(r, g, b)
    return h.between(*GREEN_HUE) & (s >= GREEN_SATURATION) & v.between(*GREEN_VALUE)


def is_white_marking(r: Column, g: Column, b: Column) -> Column:
    _, s, v = _hsv(r, g, b)
    return (s <= WHITE_SATURATION) & (v >= WHITE_VALUE)


def verdict(cls: Column, green: tuple[Column, Column], white: tuple[Column, Column], bright: tuple[Column, Column]) -> Column:
    """What two years' imagery of a site says; shares are null where a year has no image."""
    both = green[0].isNotNull() & green[1].isNotNull()
    painted = cls.isin(*PAINTED)
    lit = (F.coalesce(bright[0], num(0)) >= DARK) & (F.coalesce(bright[1], num(0)) >= DARK)
    changed = (painted & (F.abs(green[1] - green[0]) >= GREEN_DELTA)) | (F.abs(white[1] - white[0]) >= WHITE_DELTA)
    bare = painted & (green[1] < GREEN_PRESENT) & (white[1] < WHITE_PRESENT)
    seen = F.when(~lit | (white[0] >= GLARE) | (white[1] >= GLARE), "unclear").when(changed, "changed").when(bare, "no_markings").otherwise("ok")
    return F.when(both, seen).when(green[1].isNull(), "no_imagery").otherwise("ok")
