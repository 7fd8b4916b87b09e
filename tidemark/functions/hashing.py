"""Perceptual hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.constants import NO_HASH

GRID_X, GRID_Y = 9, 8


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def luma_image(rgba: Column) -> Column:
    """RGBA bytes -> one luma value per pixel."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(rgba) / 4).cast("int") - 1), lambda p: luma(F.get(rgba, p * 4), F.get(rgba, p * 4 + 1), F.get(rgba, p * 4 + 2)))


def dhash(image: Column, width: int, height: int) -> Column:
    """16 hex digits: in a 9 x 8 grid of box means, whether each cell is darker than its right neighbour.

    image holds width * height values row by row; an empty or too short image is an error.
    """
    if width <= 0 or height <= 0:
        raise ValueError("an image has pixels")
    checked = F.when(F.size(image) >= width * height, image).otherwise(F.raise_error(F.lit("the image is too short")))
    low_x = [gx * width // GRID_X for gx in range(GRID_X)]
    low_y = [gy * height // GRID_Y for gy in range(GRID_Y)]
    high_x = [max(low_x[g] + 1, (g + 1) * width // GRID_X) for g in range(GRID_X)]
    high_y = [max(low_y[g] + 1, (g + 1) * height // GRID_Y) for g in range(GRID_Y)]

    def box(gx: int, gy: int) -> Column:
        cells = [F.get(checked, F.lit(y * width + x)).cast("double") for y in range(low_y[gy], high_y[gy]) for x in range(low_x[gx], high_x[gx])]
        if len(cells) == 1:
            return cells[0]
        return F.aggregate(F.array(*cells), F.lit(0.0), lambda a, x: a + x) / len(cells)

    grid = [[box(gx, gy) for gx in range(GRID_X)] for gy in range(GRID_Y)]
    darker = [F.when(row[x] < row[x + 1], F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")) for row in grid for x in range(GRID_X - 1)]
    bits = F.aggregate(F.array(*darker), F.lit(0).cast("long"), lambda acc, bit: F.shiftleft(acc, 1).bitwiseOR(bit))
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def as_long(digits: Column) -> Column:
    """Hex digits as a signed number of the same bits."""
    return F.conv(digits, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits; 64 for empty, unequally long or non-hex hashes."""
    sound = (F.length(a) == F.length(b)) & a.rlike("^[0-9a-fA-F]{1,16}$") & b.rlike("^[0-9a-fA-F]{1,16}$")
    return F.when(sound, F.bit_count(as_long(a).bitwiseXOR(as_long(b)))).otherwise(F.lit(64)).cast("int")


def usable(digits: Column) -> Column:
    return F.coalesce(digits, F.lit(NO_HASH)) != NO_HASH
