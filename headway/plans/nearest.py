"""Nearest points at any distance, by a pyramid of cells that both sides go down together.

Places and points are put into cubes of space, cubes into larger cubes, up to one around the globe;
every cube knows the box around what it holds. A pair of cubes says how near its points can be to its
places at least, and how far the nearest one is at most. From the top down, a cube of places keeps
the cubes of points that can hold the nearest point of one of its places; their children meet in
equi-joins on the parents. So a cube is compared with a few cubes of each size, however far the nearest
point is, and places are compared with the points of the last ones only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from headway.functions import geo

#: Cubes halve so many times down to the largest ones used, and at most so often from level to level.
FIRST_HALVINGS, HALVINGS = 4, 5
#: Bounds are kept this much wider than computed, so that distances equal to the millimetre all stay.
SLACK_M = 0.01
AXES = "xyz"
WIDTH_M = 2 * geo.EARTH_RADIUS_M * (1 + 1e-9)


def _shifts(cell_m: float) -> list[int]:
    """How many times the finest cells are doubled to get those of each level, the largest first."""
    halvings = max(FIRST_HALVINGS, math.ceil(math.log2(WIDTH_M / cell_m)))
    below = halvings - FIRST_HALVINGS
    levels = math.ceil(below / HALVINGS)
    return [below - below * k // levels for k in range(levels + 1)] if levels else [0]


def _placed(df: DataFrame, lat: str, lon: str, shifts: Sequence[int]) -> DataFrame:
    """Add the place in space and its finest cell. Straight distances there order as distances on the ground."""
    size = WIDTH_M / 2 ** (FIRST_HALVINGS + shifts[0])
    unit = {"x": f"cos(radians({lat})) * cos(radians({lon}))", "y": f"cos(radians({lat})) * sin(radians({lon}))",
            "z": f"sin(radians({lat}))"}
    placed = df.selectExpr("*", *[f"{geo.EARTH_RADIUS_M}D * {u} AS _{a}" for a, u in unit.items()])
    return placed.selectExpr("*", *[f"floor((_{a} + {geo.EARTH_RADIUS_M}D) / {size}D) AS _c{a}" for a in AXES])


def _pyramid(placed: DataFrame, keys: Sequence[str], shifts: Sequence[int]) -> DataFrame:
    """The cells of all levels with the box around their content.

    The level comes out as an aggregate, so a filter on it stays above the shuffle that all levels share.
    """
    sizes = f"posexplode(array({', '.join(f'{s}' for s in shifts)})) AS (_at, _shift)"
    each = placed.selectExpr(*keys, *[f"_{a}" for a in AXES], *[f"_c{a}" for a in AXES], sizes)
    cells = [F.expr(f"shiftright(_c{a}, _shift)").alias(f"_c{a}") for a in AXES]
    return each.groupBy(*keys, "_at", *cells).agg(F.max("_at").alias("_level"), *[
        F.expr(f"{f}(_{a})").alias(f"_{end}{a}") for a in AXES for end, f in (("lo", "min"), ("hi", "max"))])


def _side(pyramid: DataFrame, keys: Sequence[str], side: str, level: int, up: int) -> DataFrame:
    """A level's cells and parents, all names marked with the side."""
    return pyramid.where(F.col("_level") == level).selectExpr(
        *[f"{k} AS {side}_{k}" for k in keys], *[f"_c{a} AS {side}_c{a}" for a in AXES],
        *[f"shiftright(_c{a}, {up}) AS {side}_up{a}" for a in AXES],
        *[f"_{end}{a} AS {side}_{end}{a}" for a in AXES for end in ("lo", "hi")])


LEAST = "sqrt(" + " + ".join(
    f"pow(greatest(0D, s_lo{a} - h_hi{a}, h_lo{a} - s_hi{a}), 2D)" for a in AXES) + ")"
MOST = "sqrt(" + " + ".join(f"pow(greatest(s_hi{a} - h_lo{a}, h_hi{a} - s_lo{a}), 2D)" for a in AXES) + ")"


def cell_pairs(places: DataFrame, points: DataFrame, keys: Sequence[str], shifts: Sequence[int]) -> DataFrame:
    """Finest cells of places (h) with the finest cells of points (s) that may hold the nearest one to a place."""
    homes, sites = _pyramid(places, keys, shifts), _pyramid(points, keys, shifts)
    own = [f"h_{k}" for k in keys] + [f"h_c{a}" for a in AXES]
    pairs = None
    for level, shift in enumerate(shifts):
        up = shifts[level - 1] - shift if level else FIRST_HALVINGS
        one, two = (_side(p, keys, s, level, up) for p, s in ((homes, "h"), (sites, "s")))
        same = [f"h_{k} = s_{k}" for k in keys]
        if pairs is None:  # Below the cube around the globe.
            met = one.join(two, F.expr(" AND ".join(same + [f"h_up{a} = s_up{a}" for a in AXES])))
        else:
            met = pairs.join(one, F.expr(" AND ".join(
                [f"p_{k} = h_{k}" for k in keys] + [f"ph_c{a} = h_up{a}" for a in AXES])))
            met = met.join(two, F.expr(" AND ".join(
                [*same, *(f"ps_c{a} = s_up{a}" for a in AXES), f"{LEAST} <= _within + {SLACK_M}D"])))
        near = met.selectExpr(*own, *[f"s_c{a}" for a in AXES], f"{LEAST} AS _least", f"{MOST} AS _most")
        near = near.selectExpr("*", f"min(_most) OVER (PARTITION BY {', '.join(own)}) AS _within") \
            .where(F.expr(f"_least <= _within + {SLACK_M}D"))
        pairs = near.selectExpr(*[f"h_{k} AS p_{k}" for k in keys],
                                *[f"{s}_c{a} AS p{s}_c{a}" for s in "hs" for a in AXES], "_within")
    return pairs


def nearest(places: DataFrame, points: DataFrame, best: Column, keys: Sequence[str] = (),
            place: tuple[str, str] = ("latitude", "longitude"), point: tuple[str, str] = ("_lat", "_lon"),
            cell_m: float = 800.0) -> DataFrame:
    """Distinct places with an aggregate over candidates that hold their nearest points.

    ``best`` sees the points' columns and ``_distance`` in metres and must be decided by the nearest
    points to the millimetre. Only points with equal ``keys`` count; a place without any has no row.
    Rows without coordinates or with a null key find nothing. ``cell_m`` bounds the edge of the finest cells.
    """
    shifts = _shifts(cell_m)
    here = _placed(places.dropna(subset=[*place, *keys]).select(*keys, *place).distinct(), *place, shifts)
    there = _placed(points.dropna(subset=[*point, *keys]), *point, shifts)
    pairs = cell_pairs(here, there, keys, shifts)
    listed = here.selectExpr(*[f"{k} AS h_{k}" for k in keys], *place, *[f"_c{a} AS h_c{a}" for a in AXES])
    met = listed.join(pairs, F.expr(" AND ".join(
        [f"h_{k} = p_{k}" for k in keys] + [f"h_c{a} = ph_c{a}" for a in AXES])))
    met = met.join(there, F.expr(" AND ".join([f"h_{k} = {k}" for k in keys] + [f"ps_c{a} = _c{a}" for a in AXES])))
    distance = geo.haversine_m(*(F.col(c) for c in (*place, *point)))
    return met.withColumn("_distance", distance).groupBy(
        *[F.col(f"h_{k}").alias(k) for k in keys], *place).agg(best)
