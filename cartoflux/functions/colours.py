"""Colours of map cells: piecewise linear ramps as column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The colours of each view of a map, from its lowest value to its highest.
RAMPS = {
    "umatrix": ("#e53e3e", "#ecc94b"),
    "frequencies": ("#38a169", "#dd6b20", "#e53e3e"),
    "errors": ("#cbd5e0", "#4a5568"),
    "viridis": ("#440154", "#3b528b", "#21918c", "#5ec962", "#fde725"),
    "cividis": ("#00204d", "#414d6b", "#7c7b78", "#b9ad71", "#ffea46"),
    "standard": ("#38a169", "#ecc94b", "#e53e3e"),
}

#: Cells of noise, and cells without any row in the view of errors.
NOISE_COLOUR, EMPTY_COLOUR = "#2d3748", "#1a202c"


def ramp(value: Column, low: Column, high: Column, stops: Sequence[str], middle: Column | None = None) -> Column:
    """The colour at a value's place between low and high as "#rrggbb", values beyond taking the ends' colours; where
    low and high are equal, the first. ``middle`` is where the middle one of three colours lies, if inside."""
    pieces = len(stops) - 1
    share = F.least(F.greatest(F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    place = share * pieces
    if middle is not None:
        centre = F.when((middle > low) & (middle < high), middle).otherwise((low + high) / 2)
        half = F.when(value <= centre, F.try_divide(value - low, centre - low)).otherwise(1 + F.try_divide(value - centre, high - centre))
        place = F.least(F.greatest(F.coalesce(half, F.lit(0.0)), F.lit(0.0)), F.lit(2.0))
    piece = F.least(F.floor(place).cast("int"), F.lit(pieces - 1))
    channels = []
    for at in (1, 3, 5):
        table = F.array(*[F.lit(int(s[at : at + 2], 16)) for s in stops])
        a, b = F.element_at(table, piece + 1), F.element_at(table, piece + 2)
        channels.append(F.lpad(F.lower(F.hex(F.floor(a + (b - a) * (place - piece) + 0.5).cast("long"))), 2, "0"))
    return F.when(value.isNotNull(), F.concat(F.lit("#"), *channels))
