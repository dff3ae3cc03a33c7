"""Least squares over the time behind each row, at whatever uneven times rows stand."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Time buckets are so many window widths long.
BUCKET_WIDTHS = 2
#: Points of windows that are laid out at a time.
PAIRS = 1 << 18
#: A parabola needs times that spread over this share of the width (as a standard deviation), and a determinant above this share of
#: its largest term: times that are nearly one or two points have none.
SPREAD, SINGULAR = 0.05, 1e-3


def window_fits(df: DataFrame, keys: list[str], time: str, value: str, width: float, unit: float = 1) -> DataFrame:
    """Adds ``n``, ``slope``, ``curvature`` and ``r2`` of ``value`` over ``time`` (a number) from the rows with a time in [t - width, t].

    ``slope`` and ``r2`` are those of the line, ``curvature`` is twice the quadratic coefficient of the parabola (the closed
    solution of its normal equations about the mean time), both by ``unit`` of time. They are null with less than two, for the curvature
    three, different times (which also have to spread, see SPREAD); ``r2`` is null for a constant value. Rows without a time or a
    value have no fit and are in none.

    Whether a row is in a window is decided on times as they are (whole numbers stay whole), and sums are taken of differences
    from the window's means, so that times seconds apart keep their digits. Rows are dealt out by key and time bucket, each bucket with a
    copy of the ``width`` before it: a key with very many rows is no single task. A task goes through its rows in order and
    holds those of one width and a batch.
    """
    span = BUCKET_WIDTHS * width
    t, bucket = F.col(time).cast("double"), "_bucket"
    fine = df.withColumn("_y", F.when(t.isNotNull() & ~F.isnan(t), F.nanvl(F.col(value).cast("double"), F.lit(None))))
    own = F.coalesce(F.floor(t / span), F.lit(0))
    until = F.when((F.col("_y").isNotNull()) & (t >= (own + 1) * span - width), own + 1).otherwise(own)
    some = fine.where("_y IS NOT NULL").withColumn("_own", own).withColumn(bucket, F.explode(F.sequence("_own", until)))
    found = T.StructType([*df.schema.fields, *[T.StructField(n, T.LongType() if n == "n" else T.DoubleType()) for n in ("n", "slope", "curvature", "r2")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            # Rows of the last time may have equals in the next batch.
            table, held = _fitted(rows, keys, time, width, unit, False)
            yield from table.select(found.names).to_batches()
        if held is not None:
            yield from _fitted(held, keys, time, width, unit, True)[0].select(found.names).to_batches()

    ordered = some.withColumn("_done", F.lit(False)).repartition(*keys, bucket).sortWithinPartitions(*keys, bucket, time)
    fits = ordered.mapInArrow(run, found)
    none = fine.where("_y IS NULL").select(*df.columns, F.lit(0).cast("long").alias("n"), *[F.lit(None).cast("double").alias(c) for c in ("slope", "curvature", "r2")])
    return fits.unionByName(none)


def _fitted(rows: pa.Table, keys: list[str], time: str, width: float, unit: float, last: bool) -> tuple[pa.Table, pa.Table]:
    """Fits of the rows that are not done yet, up to the last time (``last``: of that, too), and the rows that later ones need."""
    n = rows.num_rows
    stamp = rows.column(time)
    t = stamp.to_numpy() if pa.types.is_integer(stamp.type) else stamp.cast("float64").to_numpy()
    fresh = np.zeros(n, bool)
    fresh[:1] = True
    for k in (*keys, "_bucket"):
        code = rows.column(k).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        fresh[1:] |= code[1:] != code[:-1]
    group = np.cumsum(fresh)
    # Within a group times ascend: first and last row of each window by bisection over all groups at once.
    starts = np.flatnonzero(fresh)
    upto = np.flatnonzero(np.r_[fresh[1:] | (t[1:] != t[:-1]), True]) + 1
    hi = upto[np.searchsorted(upto, np.arange(n), side="right")]
    lo = np.empty(n, np.int64)
    for a, b in zip(starts, np.r_[starts[1:], n]):
        lo[a:b] = a + np.searchsorted(t[a:b], t[a:b] - width, side="left")
    ready = np.ones(n, bool) if last else (group < group[-1]) | (t < t[-1])
    mine = np.flatnonzero(ready & ~rows.column("_done").to_numpy() & (rows.column("_own").to_numpy() == rows.column("_bucket").to_numpy()))
    y, out = rows.column("_y").to_numpy(), np.full((3, len(mine)), np.nan)
    size = (hi - lo)[mine]
    # Windows of so many rows at a time, or a single larger one.
    edges = np.searchsorted(np.cumsum(size), np.arange(PAIRS, size.sum() + PAIRS, PAIRS), side="left") + 1 if len(mine) else []
    a = 0
    for b in np.unique(np.minimum(edges, len(mine))) if len(mine) else []:
        at, count = mine[a:b], size[a:b]
        first = np.cumsum(count) - count
        which = np.repeat(np.arange(b - a), count)
        row = np.arange(len(which)) - first[which] + lo[at][which]
        out[:, a:b] = _solved((t[row] - t[at][which]) / unit, y[row], which, first, count, width / unit)
        a = b
    fits = rows.take(mine)
    for name, v in (("n", pa.array(size)), *zip(("slope", "curvature", "r2"), (pa.array(v, mask=np.isnan(v)) for v in out))):
        fits = fits.append_column(name, v)
    # Later rows are of the last group, no earlier than its last time.
    keep = ~ready | ((group == group[-1]) & (t >= t[-1] - width))
    done = rows.set_column(rows.schema.get_field_index("_done"), rows.schema.field("_done"), pa.array(ready))
    return fits, done.filter(pa.array(keep))


def _solved(x: np.ndarray, y: np.ndarray, which: np.ndarray, first: np.ndarray, count: np.ndarray, width: float) -> tuple:
    """Slope, curvature and r2 (NaN: none) of windows whose points follow one another."""
    total = lambda v: np.add.reduceat(v, first)
    differ = lambda v: np.maximum.reduceat(v, first) > np.minimum.reduceat(v, first)
    u, v = x - (total(x) / count)[which], y - (total(y) / count)[which]
    m2, m3, m4, uv, uuv, vv = (total(s) for s in (u * u, u * u * u, u * u * u * u, u * v, u * u * v, v * v))
    det = m2 * (m4 - m2 * m2 / count) - m3 * m3
    line = differ(x)
    with np.errstate(divide="ignore", invalid="ignore"):
        curved = line & (count >= 3) & (m2 >= (SPREAD * width) ** 2 * count) & (det > SINGULAR * m2 * m4)
        return np.where(line, uv / m2, np.nan), np.where(curved, 2 * (m2 * uuv - m3 * uv) / det, np.nan), np.where(line & differ(y), uv * uv / (m2 * vv), np.nan)


def path_fits(points: Column) -> Column:
    """struct(points, slope, concavity, exponent, r2) of a path: an array of struct(x, y), its origin first.

    ``concavity`` is minus the parabola's curvature times the last x squared over the last y, about 1.6 for a square root and 0
    for a line; ``exponent`` and ``r2`` belong to the line through the logarithms of the points with x and y above 0, four at
    least. A whole path is one array, so it has to be short.
    """
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, p: s + f(p))

    def line(a: Column, x, y) -> dict[str, Column]:
        n = F.size(a).cast("double")
        mx, my = F.try_divide(total(a, x), n), F.try_divide(total(a, y), n)
        xx, xy, yy = total(a, lambda p: (x(p) - mx) * (x(p) - mx)), total(a, lambda p: (x(p) - mx) * (y(p) - my)), total(a, lambda p: (y(p) - my) * (y(p) - my))
        return {"n": n, "mx": mx, "my": my, "xx": xx, "slope": F.when(xx > 1e-18, xy / xx), "r2": F.when((xx > 1e-18) & (yy > 1e-12), xy * xy / (xx * yy)), "xy": xy}

    x, y = (lambda p: p["x"]), (lambda p: p["y"])
    a = line(points, x, y)
    u = lambda p: p["x"] - a["mx"]
    m3, m4 = total(points, lambda p: u(p) * u(p) * u(p)), total(points, lambda p: u(p) * u(p) * u(p) * u(p))
    uuy = total(points, lambda p: u(p) * u(p) * (p["y"] - a["my"]))
    det = a["xx"] * (m4 - F.try_divide(a["xx"] * a["xx"], a["n"])) - m3 * m3
    curvature = F.when((a["n"] >= 3) & (det > SINGULAR * a["xx"] * m4), 2 * (a["xx"] * uuy - m3 * a["xy"]) / det)
    last = F.try_element_at(points, F.lit(-1))
    concavity = F.when((last["x"] > 0) & (last["y"] > 0), -curvature * last["x"] * last["x"] / last["y"])
    logs = F.transform(F.filter(points, lambda p: (p["x"] > 0) & (p["y"] > 0)), lambda p: F.struct(F.ln(p["x"]).alias("x"), F.ln(p["y"]).alias("y")))
    b = line(logs, x, y)
    enough = F.size(logs) >= 4
    return F.struct(
        F.size(points).cast("long").alias("points"), a["slope"].alias("slope"), concavity.alias("concavity"), F.when(enough, b["slope"]).alias("exponent"), F.when(enough, b["r2"]).alias("r2")
    )


def trailing_path_fits(df: DataFrame, key: str, order: list[str], step: str, size: str, value: str, rows: int) -> DataFrame:
    """(df, flow, total, last_y, points, slope, concavity, exponent, r2): ``path_fits`` of the last ``rows`` rows of the key up to each one.

    A path begins at its first row; x is the running sum of ``step`` (a whole number) after it, y the value less the first one,
    both times the sign of the last sum, ``flow``. ``total`` is the sum of ``size``. Rows without a flow are left out. Nulls in ``step`` and ``size`` count
    as 0; a path with a null value has no fit. A task goes through its rows in order, many at a time, and keeps the last ones.
    """
    number = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    doubles = {f"_{c}": F.col(c).cast("double") for c in (step, size, value)}
    ordered = df.withColumn("_number", F.least(number, F.lit(rows))).withColumns(doubles)
    kinds = {"flow": T.LongType(), "total": T.LongType(), "last_y": T.DoubleType(), "points": T.LongType(), "slope": T.DoubleType(), "concavity": T.DoubleType(), "exponent": T.DoubleType(), "r2": T.DoubleType()}
    schema, given = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in kinds.items()]]), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        past = np.zeros((3, rows - 1))
        for batch in batches:
            own = np.stack([pc.fill_null(batch.column(f"_{c}"), gap).to_numpy() for c, gap in ((step, 0.0), (size, 0.0), (value, np.nan))])
            seen = np.concatenate([past, own], axis=1)
            past = seen[:, seen.shape[1] - rows + 1 :]
            count = batch.column("_number").to_numpy()
            found = _paths(*np.lib.stride_tricks.sliding_window_view(seen, rows, axis=1), count)
            some = np.flatnonzero(found["flow"] != 0)
            fits = pa.Table.from_batches([batch]).take(some).select(given)
            for name, kind in kinds.items():
                v = found[name][some]
                fits = fits.append_column(name, pa.array(v.astype(np.int64)) if kind == T.LongType() else pa.array(v, mask=np.isnan(v)))
            yield from fits.to_batches()

    return ordered.mapInArrow(run, schema)  # as the window leaves them: all rows of a key in one task, in order


def _paths(step: np.ndarray, size: np.ndarray, value: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
    """Fits of paths that are the last ``count`` of each row's columns."""
    width = step.shape[1]
    at = np.arange(width)
    here, later = at >= width - count[:, None], at > width - count[:, None]
    x = np.cumsum(np.where(later, step, 0.0), axis=1)
    flow = x[:, -1]
    x = np.sign(flow)[:, None] * x
    y = np.sign(flow)[:, None] * (value - np.take_along_axis(value, (width - count)[:, None].astype(np.int64), axis=1))

    def line(x, y, on):
        n = on.sum(axis=1)
        total = lambda v: np.where(on, v, 0.0).sum(axis=1)
        u, v = x - (total(x) / n)[:, None], y - (total(y) / n)[:, None]
        xx, xy, yy = total(u * u), total(u * v), total(v * v)
        return total, u, v, n, xx, xy, np.where(xx > 1e-18, xy / xx, np.nan), np.where((xx > 1e-18) & (yy > 1e-12), xy * xy / (xx * yy), np.nan)

    with np.errstate(all="ignore"):
        total, u, v, n, xx, xy, slope, _ = line(x, y, here)
        m3, m4, uuy = total(u * u * u), total(u * u * u * u), total(u * u * v)
        det = xx * (m4 - xx * xx / n) - m3 * m3
        curvature = np.where((n >= 3) & (det > SINGULAR * xx * m4), 2 * (xx * uuy - m3 * xy) / det, np.nan)
        last_x, last_y = x[:, -1], y[:, -1]
        concavity = np.where((last_x > 0) & (last_y > 0), -curvature * last_x * last_x / last_y, np.nan)
        logs = here & (x > 0) & (y > 0)
        *_, exponent, r2 = line(np.log(np.where(logs, x, 1.0)), np.log(np.where(logs, y, 1.0)), logs)
        enough = logs.sum(axis=1) >= 4
    return {
        "flow": flow, "total": np.where(later, size, 0.0).sum(axis=1), "last_y": last_y, "points": n, "slope": slope, "concavity": concavity,
        "exponent": np.where(enough, exponent, np.nan), "r2": np.where(enough, r2, np.nan),
    }
