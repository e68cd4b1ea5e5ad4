"""Layout helpers: responses of many shapes as rows, windows of a grid, rescaled intrinsics, source kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flatten_response(nested: Column, channels_first: bool, cap: int | None = None) -> Column:
    """[N, 16] from [16, G, H] (channels first) or [G, H, 16]; at most ``cap`` rows."""
    if channels_first:
        rows = F.transform(nested, lambda c: F.flatten(c))
        out = F.transform(F.sequence(F.lit(0), F.size(F.get(rows, F.lit(0))) - 1), lambda i: F.transform(rows, lambda c: F.get(c, i)))
    else:
        out = F.flatten(nested)
    return out if cap is None else F.slice(out, 1, cap)


def scaled_intrinsics(fx: Column, fy: Column, cx: Column, cy: Column, width: Column, height: Column, to_width: int, to_height: int) -> Column:
    """Camera intrinsics after a resize."""
    sx, sy = F.lit(float(to_width)) / width, F.lit(float(to_height)) / height
    return F.struct((fx * sx).alias("fx"), (fy * sy).alias("fy"), (cx * sx).alias("cx"), (cy * sy).alias("cy"))


def grid_ids(frames: int, height: int, width: int) -> Column:
    """All (f, h, w) of a grid, in order."""
    axis = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    return F.flatten(F.flatten(F.transform(axis(frames), lambda f: F.transform(axis(height), lambda h: F.transform(axis(width), lambda w: F.struct(f.alias("f"), h.alias("h"), w.alias("w")))))))


def source_kind(path: Column) -> Column:
    """How a camera source is stored, by its path."""
    return F.when(F.contains(path, F.lit("::")), "container").when(path.rlike(r"(?i)\.(mp4|avi|mov|mkv)$"), "video").when(path.rlike(r"(?i)\.(h5|hdf5)$"), "sidecar").otherwise("folder")


def sample_timestep(u: Column, steps: int) -> Column:
    """A time step from a uniform number in [0, 1]."""
    return F.least(F.greatest(F.floor(u * steps), F.lit(0)), F.lit(steps - 1))
