"""Planes, slices and orientation of voxel arrays, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLANES = ("axial", "coronal", "sagittal")


def linear_index(i: Column, j: Column, k: Column, nx: Column, ny: Column) -> Column:
    return i + nx * (j + ny * k)


def _by_plane(plane: Column, axial, coronal, sagittal) -> Column:
    return F.when(plane == "axial", axial).when(plane == "coronal", coronal).when(plane == "sagittal", sagittal)


def plane_geometry(plane: Column, nx: Column, ny: Column, nz: Column, sx: Column, sy: Column, sz: Column) -> Column:
    """Width, height, slice count, pixel spacing and aspect of a plane through a volume."""
    across, down = _by_plane(plane, sx, sx, sy), _by_plane(plane, sy, sz, sz)
    return F.struct(
        _by_plane(plane, nx, nx, ny).alias("width"), _by_plane(plane, ny, nz, nz).alias("height"), _by_plane(plane, nz, ny, nx).alias("slices"),
        across.alias("horizontal"), down.alias("vertical"), (down / across).alias("aspect"),
    )


def _mirrored(plane: Column, neurological: Column) -> Column:
    return neurological & (plane != "sagittal")


def voxel_of(plane: Column, neurological: Column, column: Column, row: Column, slice_: Column, nx: Column, ny: Column, nz: Column) -> Column:
    """Voxel (i, j, k) under a pixel: coronal and sagittal run top down, neurological views swap left and right."""
    width = _by_plane(plane, nx, nx, ny)
    c = F.when(_mirrored(plane, neurological), width - 1 - column).otherwise(column)
    up = nz - 1 - row
    return F.struct(_by_plane(plane, c, c, slice_).alias("i"), _by_plane(plane, row, slice_, c).alias("j"), _by_plane(plane, slice_, up, up).alias("k"))


def pixel_of(plane: Column, neurological: Column, i: Column, j: Column, k: Column, nx: Column, ny: Column, nz: Column) -> Column:
    """Pixel (column, row, slice) of a voxel, the inverse of :func:`voxel_of`."""
    width = _by_plane(plane, nx, nx, ny)
    raw = _by_plane(plane, i, i, j)
    return F.struct(
        F.when(_mirrored(plane, neurological), width - 1 - raw).otherwise(raw).alias("column"),
        _by_plane(plane, j, nz - 1 - k, nz - 1 - k).alias("row"), _by_plane(plane, k, j, i).alias("slice"),
    )


def edge_letters(plane: Column, neurological: Column) -> Column:
    """Letters at the left, right, top and bottom edge."""
    swap = _mirrored(plane, neurological)
    side = lambda a, b: F.when(swap, b).otherwise(a)
    return F.struct(
        F.when(plane == "sagittal", "A").otherwise(side("R", "L")).alias("left"), F.when(plane == "sagittal", "P").otherwise(side("L", "R")).alias("right"),
        F.when(plane == "axial", "A").otherwise("S").alias("top"), F.when(plane == "axial", "P").otherwise("I").alias("bottom"),
    )


def extract_slice(voxels: DataFrame, grids: DataFrame, plane: str, slice_: int, neurological: bool = False, value: str = "hu") -> DataFrame:
    """volume_id, row, values of one slice in screen order; rows of the screen stay apart, so no task holds a volume."""
    if plane not in PLANES:
        raise ValueError(f"plane must be one of {', '.join(PLANES)}")
    rows = voxels.join(F.broadcast(grids), "volume_id")
    p = pixel_of(F.lit(plane), F.lit(neurological), F.col("x"), F.col("y"), F.col("z"), F.col("nx"), F.col("ny"), F.col("nz"))
    cut = rows.select("volume_id", p.alias("p"), F.col(value).alias("v")).where(F.col("p.slice") == slice_)
    return cut.groupBy("volume_id", F.col("p.row").alias("row")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p.column", "v"))), lambda s: s["v"]).alias("values")
    )


def left_right_axis(direction: Column) -> Column:
    """Axis 0..2 that runs closest to left-right: the largest of the first row of a 3x3 direction matrix, the first among equals."""
    first = F.transform(F.slice(direction, 1, 3), lambda v: F.abs(v))
    return (F.array_position(first, F.array_max(first)) - 1).cast("int")


def mirrored(voxels: DataFrame, grids: DataFrame) -> DataFrame:
    """Voxels with their index reversed along the left-right axis; ``grids`` has the axis of each volume in ``axis``."""
    at = voxels.join(F.broadcast(grids.select("volume_id", "nx", "ny", "nz", "axis")), "volume_id")
    flip = lambda c, n, axis: F.when(F.col("axis") == axis, F.col(n) - 1 - F.col(c)).otherwise(F.col(c)).alias(c)
    return at.select(*[c for c in voxels.columns if c not in "xyz"], flip("z", "nz", 2), flip("y", "ny", 1), flip("x", "nx", 0))


def same_grid(a: str, b: str) -> Column:
    """Whether two grid structs (size, origin, spacing, direction arrays) agree: origins to 1e-4, the rest to 1e-6."""
    near = lambda name, most: F.forall(F.zip_with(F.col(f"{a}.{name}"), F.col(f"{b}.{name}"), lambda x, y: F.abs(x - y) < most), lambda ok: F.coalesce(ok, F.lit(False)))
    return (F.col(f"{a}.size") == F.col(f"{b}.size")) & near("origin", 1e-4) & near("spacing", 1e-6) & near("direction", 1e-6)


def check_spacing(sx: Column, sy: Column, sz: Column, nx: Column, ny: Column, nz: Column) -> Column:
    """True for a volume with positive sizes and spacings."""
    return (nx > 0) & (ny > 0) & (nz > 0) & (sx > 0) & (sy > 0) & (sz > 0)
