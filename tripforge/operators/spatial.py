"""Square grid cells over planar coordinates in metres: points and edges in cells, areas of cells at a border, cell metrics.

A shape is an array of its corners, array<struct<x: double, y: double>>, without the first one again at its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import rounded


def cell_index(x: Column, origin: float, size: float) -> Column:
    return F.floor((x - F.lit(float(origin))) / F.lit(float(size))).cast("int")


def with_cells(points: DataFrame, x: str, y: str, origin: tuple[float, float], size: float) -> DataFrame:
    """Add grid_x and grid_y: a point lies in a cell from its lower edges on."""
    return points.withColumns({"grid_x": cell_index(F.col(x), origin[0], size), "grid_y": cell_index(F.col(y), origin[1], size)})


def _meets(a: Column, b: Column, low: float, size: float):
    """Where, as a share of the way from a to b, a numbered grid line lies."""
    return lambda k: (k * F.lit(float(size)) + F.lit(float(low)) - a) / (b - a)


def segments_by_cell(edges: DataFrame, origin: tuple[float, float], size: float) -> DataFrame:
    """Edges (x1, y1, x2, y2, ...) once for each cell that they cross, with ``length_m``, the length inside it.

    The edge is followed from one grid line to the next: the places where it meets lines of either direction, in order, cut it
    into pieces, and each piece's middle tells its cell. So an edge makes as many rows as it crosses lines, and one more. Cells
    met in a point only are left out; an edge without length lies in its point's cell.
    """
    cuts = []
    for axis, low in (("x", origin[0]), ("y", origin[1])):
        a, b = F.col(f"{axis}1"), F.col(f"{axis}2")
        first, last = cell_index(F.least(a, b), low, size) + 1, cell_index(F.greatest(a, b), low, size)
        lines = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        cuts.append(F.transform(lines, _meets(a, b, low, size)))
    inner = F.array_distinct(F.array_sort(F.filter(F.concat(*cuts), lambda t: (t > 0) & (t < 1))))
    pieces = F.transform(F.concat(F.array(F.lit(0.0)), inner), lambda t, i: F.struct(t.alias("t"), F.coalesce(F.get("__inner", i), F.lit(1.0)).alias("u")))
    rows = edges.withColumn("__inner", inner).withColumn("__piece", F.explode(pieces)).drop("__inner")
    middle = (F.col("__piece.t") + F.col("__piece.u")) / 2
    place = lambda axis: F.col(f"{axis}1") + (F.col(f"{axis}2") - F.col(f"{axis}1")) * middle
    whole = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    rows = rows.withColumns({"grid_x": cell_index(place("x"), origin[0], size), "grid_y": cell_index(place("y"), origin[1], size), "length_m": whole * (F.col("__piece.u") - F.col("__piece.t"))})
    longer = (F.col("__piece.u") - F.col("__piece.t") > 1e-12) | (whole == 0)
    return rows.where(longer).drop("__piece")


def _half(on_x: bool, bound: Column, side: float) -> Column:
    """A half plane: beyond (side 1) or before (side -1) a line at right angles to an axis."""
    return F.struct(F.lit(on_x).alias("on_x"), bound.cast("double").alias("bound"), F.lit(side).alias("side"))


def clip_to_half(shape: Column, half: Column) -> Column:
    """The part of a shape in a half plane (Sutherland and Hodgman): every side of the shape leaves its end if that is
    inside, after the place where it meets the line if its ends are on different sides."""
    beyond = lambda p: (F.when(half["on_x"], p["x"]).otherwise(p["y"]) - half["bound"]) * half["side"]

    def meet(p: Column, q: Column) -> Column:
        share = F.try_divide(beyond(p), beyond(p) - beyond(q))
        at = lambda c, on_line: F.when(on_line, half["bound"]).otherwise(p[c] + (q[c] - p[c]) * share).alias(c)
        return F.struct(at("x", half["on_x"]), at("y", ~half["on_x"]))

    def left_by(q: Column, i: Column) -> Column:
        p = F.when(i == 0, F.element_at(shape, -1)).otherwise(F.get(shape, i - 1))
        crossing = (beyond(p) >= 0) != (beyond(q) >= 0)
        met = F.when(crossing & (beyond(q) >= 0), F.array(meet(p, q), q)).when(crossing, F.array(meet(p, q)))
        return met.when(beyond(q) >= 0, F.array(q)).otherwise(F.slice(F.array(q), 1, 0))

    return F.when(F.size(shape) > 0, F.flatten(F.transform(shape, left_by))).otherwise(shape)


def clip_to_cell(shape: Column, size: float, origin: tuple[float, float] = (0.0, 0.0)) -> Column:
    """The part of a shape inside the cell grid_x, grid_y: its four half planes one after the other, so that no step is repeated within the next."""
    halves = []
    for axis, low in (("x", origin[0]), ("y", origin[1])):
        near = F.col(f"grid_{axis}") * F.lit(float(size)) + F.lit(float(low))
        halves += [_half(axis == "x", near, 1.0), _half(axis == "x", near + F.lit(float(size)), -1.0)]
    return F.aggregate(F.array(*halves), shape, clip_to_half)


def area(shape: Column) -> Column:
    """Area of a shape by the sum of cross products of its sides; corners may go either way round."""
    sides = F.transform(shape, lambda q, i: F.when(i == 0, F.element_at(shape, -1)).otherwise(F.get(shape, i - 1))["x"] * q["y"] - q["x"] * F.when(i == 0, F.element_at(shape, -1)).otherwise(F.get(shape, i - 1))["y"])
    return F.when(F.size(shape) > 0, F.abs(F.aggregate(sides, F.lit(0.0), lambda n, s: n + s)) / 2).otherwise(F.lit(0.0))


def city_grid(cities: DataFrame, size: float, shape: str = "shape") -> DataFrame:
    """The cells (city, grid_x, grid_y, x0, y0, cell_area_km2) of each city's grid that its shape (city, shape) has a part in.

    A grid begins at the least coordinates of its shape; a cell's area is that of the shape within it.
    """
    low = {a: F.array_min(F.col(f"{shape}.{a}")) for a in "xy"}
    high = {a: F.array_max(F.col(f"{shape}.{a}")) for a in "xy"}
    bounds = cities.select("city", shape, *[v.alias(f"{a}{n}") for n, side in (("0", low), ("1", high)) for a, v in side.items()])
    moved = bounds.withColumn("__moved", F.transform(shape, lambda p: F.struct((p["x"] - F.col("x0")).alias("x"), (p["y"] - F.col("y0")).alias("y"))))
    cells = moved
    for a in "xy":
        n = F.greatest(F.lit(1), F.ceil((F.col(f"{a}1") - F.col(f"{a}0")) / F.lit(float(size))).cast("int"))
        cells = cells.withColumn(f"grid_{a}", F.explode(F.sequence(F.lit(0), n - 1)))
    inside = F.get(F.transform(F.array(clip_to_cell(F.col("__moved"), size)), area), F.lit(0))
    return cells.select("city", "grid_x", "grid_y", "x0", "y0", (inside / 1e6).alias("cell_area_km2")).where("cell_area_km2 > 0")


def cell_table(cells: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per cell (city, grid_x, grid_y, cell_area_km2) of a grid: crossings, metres of road and their densities; cells without either stay, with zeros.

    ``nodes`` and ``edges`` have city, grid_x and grid_y, edges also ``length_m``, the length inside the cell, and ``edge_m``, that of the
    whole edge. ``road_length_m`` adds up whole edges that meet the cell, ``road_inside_m`` the lengths inside it.
    """
    at = ["city", "grid_x", "grid_y"]
    crossings = nodes.groupBy(*at).agg(F.count("*").alias("intersection_count"))
    roads = edges.groupBy(*at).agg(F.sum("edge_m").alias("road_length_m"), F.sum("length_m").alias("road_inside_m"))
    out = cells.join(crossings, at, "left").join(roads, at, "left").na.fill({"intersection_count": 0, "road_length_m": 0.0, "road_inside_m": 0.0})
    per = lambda c: rounded(F.try_divide(F.col(c), F.col("cell_area_km2")))
    return out.select(
        F.concat_ws("_", "city", "grid_x", "grid_y").alias("cell_id"), *at, "cell_area_km2", "intersection_count", rounded(F.col("road_length_m")).alias("road_length_m"), rounded(F.col("road_inside_m")).alias("road_inside_m"),
        per("intersection_count").alias("intersection_density"), per("road_length_m").alias("road_density"), per("road_inside_m").alias("road_inside_density"),
    )
