"""Missing values: sentinels, non-finite values, gap filling (PRJ4, PRJ5, WN14-WN16)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriescast.config import SENTINEL
from seriescast.operators.batches import spans, whole_series
from seriescast.operators.series import (UNB_PRE, Series, carries, index_neighbours, index_rows, join_carry,
                                         neighbours)


def sentinel_to_null(c: Column | str, sentinel: float = SENTINEL) -> Column:
    """PRJ4: the sentinel becomes SQL NULL (never NaN)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == F.lit(sentinel), F.lit(None).cast("double")).otherwise(c.cast("double"))


def nonfinite_to_null(c: Column | str) -> Column:
    """PRJ5: NaN and +-inf become NULL."""
    c = F.col(c) if isinstance(c, str) else c
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(None).cast("double")).otherwise(c)


def _ensure_index(df: DataFrame, s: Series) -> DataFrame:
    return df if "rn" in df.columns and "n" in df.columns else index_rows(df, s)


def interpolate(df: DataFrame, s: Series, cols: list[str] | None = None) -> DataFrame:
    """WN14 + WN15: linear interpolation by row position, then back-fill, then forward-fill.

    Interior gaps: ``slope * (rn - prev.rn) + prev.v`` with
    ``slope = (next.v - prev.v) / (next.rn - prev.rn)``; a leading gap takes the
    first valid value, a trailing gap the last one.  An all-null series stays null.
    """
    cols = cols or [s.value]
    numbered = "rn" in df.columns and "n" in df.columns
    if s.whole and not numbered:
        return _whole_batches(df, s, cols) if s.batches else _whole(df, s, cols)
    if not numbered and all(isinstance(df.schema[c].dataType, T.DoubleType) for c in cols):
        return _interpolated(df, s, cols)
    d = neighbours(df, s, cols) if numbered else index_neighbours(df, s, cols)
    ends = {c: [F.col(f"_{side}_{c}")[x] for side in ("prev", "next") for x in "rv"] for c in cols}
    d = d.withColumns({c: _on_line(c, *ends[c]) for c in cols})
    return d.drop(*[f"_prev_{c}" for c in cols], *[f"_next_{c}" for c in cols])


def _on_line(c: str, pr: Column, pv: Column, nr: Column, nv: Column) -> Column:
    """``c``, or its value at ``rn`` between the places and values of the neighbours."""
    slope = (nv - pv) / (nr - pr)
    return (F.when(F.col(c).isNotNull(), F.col(c)).when(pr.isNull(), nv).when(nr.isNull(), pv)
             .otherwise(slope * (F.col("rn") - pr) + pv))


def _whole(df: DataFrame, s: Series, cols: list[str]) -> DataFrame:
    """``interpolate`` of a frame without numbers whose series lie unbroken in their tasks; adds ``_tb, n, rn``.

    Running windows over the series itself: rows are numbered and filled where they lie, and Spark
    knows that they still lie there, so that later windows need no other shuffle."""
    d = (df if "_tb" in df.columns else df.withColumn("_tb", s.bucket_col())).dropna(subset=s.k)
    w = Window.partitionBy(*s.k).orderBy(s.order, *cols)
    d = d.withColumns({"rn": F.row_number().over(w).cast("long"), "n": F.count(F.lit(1)).over(Window.partitionBy(*s.k))})
    # rows without a time count in numbers and length, and fill nothing
    at = {c: F.when(F.col(c).isNotNull() & F.col("_tb").isNotNull(), F.col("rn")) for c in cols}
    value = {c: F.when(F.col("_tb").isNotNull(), F.col(c)) for c in cols}
    for side, order in (("p", w), ("n", Window.partitionBy(*s.k).orderBy(F.col("rn").desc()))):
        run = order.rowsBetween(UNB_PRE, 0)
        d = d.withColumns({name: e for c in cols for name, e in (
            (f"_{side}r_{c}", F.last(at[c], ignorenulls=True).over(run)),
            (f"_{side}v_{c}", F.last(value[c], ignorenulls=True).over(run)))})
    filled = {c: _on_line(c, *[F.col(f"_{x}_{c}") for x in ("pr", "pv", "nr", "nv")]) for c in cols}
    kept = [filled[c].alias(c) if c in filled else c for c in df.columns if c != "_tb"]
    return d.where(F.col("_tb").isNotNull()).select(*kept, "_tb", "n", "rn")


def _whole_batches(df: DataFrame, s: Series, cols: list[str]) -> DataFrame:
    """``_whole`` by Arrow batches (double columns): sorted where they lie, rows leave in the order of their series."""
    keys = s.k
    d = (df if "_tb" in df.columns else df.withColumn("_tb", s.bucket_col())).dropna(subset=keys)
    kept = [c for c in df.columns if c != "_tb"]

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_series(batches, keys):
            at = spans(batch, keys)
            timed = batch["_tb"].is_valid().to_numpy(zero_copy_only=False)
            rn, out = at.place + 1, {c: batch[c] for c in kept}
            for c in cols:
                v, ok = _values(batch[c])
                ok = ok & timed
                gaps = np.flatnonzero(~ok & timed)
                if not len(gaps):
                    continue
                before, after = (x[gaps] for x in _nearest(ok))
                b = at.own[gaps]
                has_p, has_n = before >= at.start[b], after < at.end[b]
                before, after = np.where(has_p, before, 0), np.where(has_n, after, 0)
                pv, pr, nv, nr = v[before], rn[before], v[after], rn[after]
                with np.errstate(all="ignore"):
                    line = (nv - pv) / (nr - pr) * (rn[gaps] - pr) + pv
                v, ok = v.copy(), ok.copy()
                v[gaps] = np.where(has_p & has_n, line, np.where(has_p, pv, nv))
                ok[gaps] = has_p | has_n
                out[c] = pa.array(v, mask=~ok)
            n = (at.end - at.start)[at.own]
            got = pa.RecordBatch.from_arrays([*out.values(), batch["_tb"], pa.array(n), pa.array(rn)], names=[*kept, "_tb", "n", "rn"])
            yield got if timed.all() else got.filter(pa.array(timed))

    d = d.sortWithinPartitions(*keys, s.order, *cols).select(*kept, "_tb")
    return d.mapInArrow(filled, T.StructType([*[T.StructField(f.name, f.dataType) for f in d.schema.fields],
                                              T.StructField("n", T.LongType()), T.StructField("rn", T.LongType())]))


def _interpolated(df: DataFrame, s: Series, cols: list[str]) -> DataFrame:
    """``interpolate`` of a frame without numbers, all columns of a batch at once; adds ``_tb, n, rn``.

    Windows number the rows of a time bucket, and over the small table of one row per bucket (``carries``) give
    what each bucket gets from the others; a bucket's own rows are summed up and filled by whole Arrow
    batches, in the order the numbering left them.  Both passes read the same shuffled rows: buckets'
    carries are joined on the left, so nothing is filtered for one pass only.  A task holds one batch and one bucket."""
    keys, buckets = s.k, [*s.k, "_tb"]
    d = (df if "_tb" in df.columns else df.withColumn("_tb", s.bucket_col())).dropna(subset=keys)
    at = F.row_number().over(Window.partitionBy(*buckets).orderBy(s.order, *cols)).cast("long")
    ends = [f"_b{side}{x}_{c}" for c in cols for side, x in (("l", "v"), ("l", "r"), ("f", "v"), ("f", "r"))]
    types = dict(df.dtypes) | {"_tb": d.schema["_tb"].dataType.simpleString()}
    schema = ", ".join([*[f"`{b}` {types[b]}" for b in buckets], "_c long",
                        *[f"`{e}` {'double' if e[3] == 'v' else 'long'}" for e in ends]])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_buckets(batches):
            place, start, end = _spans(batch)
            timed = batch["_tb"].is_valid().to_numpy(zero_copy_only=False)
            out = [batch[b].take(pa.array(start)) for b in buckets] + [pa.array(end - start)]
            for c in cols:
                v, ok = _values(batch[c])
                before, after = _nearest(ok & timed)
                for i, there in ((before[end - 1], before[end - 1] >= start), (after[start], after[start] < end)):
                    i = np.where(there, i, 0)
                    out += [pa.array(v[i], mask=~there), pa.array(place[i], mask=~there)]
            yield pa.RecordBatch.from_arrays(out, names=[*buckets, "_c", *ends])

    carry = carries(d.withColumn("_at", at).select(*buckets, *cols, "_at").mapInArrow(summed, schema), s, cols)
    got = ["_off", "n", *[f"_{side}in{x}_{c}" for c in cols for side in "pn" for x in "vr"]]
    carry = carry.select(*buckets, F.array(*[F.col(c).cast("double") for c in got]).alias("_in"))
    kept = [c for c in df.columns if c != "_tb"]
    d = join_carry(d, carry, s, "_tb").withColumn("_at", at)
    d = d.select(*kept, "_tb", "_at", F.when(F.col("_at") == 1, F.col("_in")).alias("_in"))

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_buckets(batches):
            batch = batch.filter(batch["_tb"].is_valid())
            if not batch.num_rows:
                continue
            place, start, end = _spans(batch)
            own = np.repeat(np.arange(len(start)), end - start)
            x, known = _values(batch["_in"].take(pa.array(start)).flatten())
            x, known = x.reshape(len(start), -1), known.reshape(len(start), -1)
            off, n = x[:, 0].astype(np.int64)[own], x[:, 1].astype(np.int64)[own]
            rn = place + off
            out = {c: batch[c] for c in kept}
            for j, c in enumerate(cols):
                v, ok = _values(batch[c])
                gaps = np.flatnonzero(~ok)
                if not len(gaps):
                    continue
                b, sides = own[gaps], []
                for k, (at_, here) in enumerate(zip(_nearest(ok), (lambda i: i >= start[b], lambda i: i < end[b]))):
                    i = at_[gaps]
                    there = here(i)
                    i, col = np.where(there, i, 0), 2 + 4 * j + 2 * k
                    sides.append((np.where(there, v[i], x[b, col]), np.where(there, rn[i], x[b, col + 1]), there | known[b, col + 1]))
                (pv, pr, has_p), (nv, nr, has_n) = sides
                with np.errstate(all="ignore"):
                    line = (nv - pv) / (nr - pr) * (rn[gaps] - pr) + pv
                v, ok = v.copy(), ok.copy()
                v[gaps] = np.where(has_p & has_n, line, np.where(has_p, pv, nv))
                ok[gaps] = has_p | has_n
                out[c] = pa.array(v, mask=~ok)
            yield pa.RecordBatch.from_arrays([*out.values(), batch["_tb"], pa.array(n), pa.array(rn)], names=[*kept, "_tb", "n", "rn"])

    return d.mapInArrow(filled, T.StructType([*[T.StructField(f.name, f.dataType) for f in (d.schema[c] for c in [*kept, "_tb"])],
                                              T.StructField("n", T.LongType()), T.StructField("rn", T.LongType())]))


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches that no time bucket is cut by (``_at`` is 1 where one starts)."""
    held: list[pa.RecordBatch] = []

    def whole() -> Iterator[pa.RecordBatch]:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    for batch in batches:
        starts = np.flatnonzero(batch["_at"].to_numpy(zero_copy_only=False) == 1)
        if not len(starts):
            held += [batch] if batch.num_rows else []
            continue
        cut = int(starts[-1])
        held.append(batch.slice(0, cut))
        yield from whole()
        held = [batch.slice(cut)]
    if held:
        yield from whole()


def _spans(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the rows in their buckets, and where each bucket starts and ends in the batch."""
    place = batch["_at"].to_numpy(zero_copy_only=False)
    start = np.flatnonzero(place == 1)
    return place, start, np.append(start[1:], len(place))


def _values(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values (anything where null) and where they are not null."""
    ok = a.is_valid().to_numpy(zero_copy_only=False)
    return (a.fill_null(0) if a.null_count else a).to_numpy(zero_copy_only=False), ok


def _nearest(ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the last marked row at or before it (-1: none), and the first at or after it (their number: none)."""
    i = np.arange(len(ok))
    return (np.maximum.accumulate(np.where(ok, i, -1)),
            np.minimum.accumulate(np.where(ok, i, len(ok))[::-1])[::-1])


def fill(df: DataFrame, s: Series, cols: list[str], method: str = "bfill") -> DataFrame:
    """WN15: back-fill (next valid value) or forward-fill (last valid value)."""
    d = _ensure_index(df, s)
    if method == "bfill":
        d = neighbours(d, s, cols, prev=False, positions=False)
        d = d.withColumns({c: F.coalesce(F.col(c), F.col(f"_next_{c}")) for c in cols})
        return d.drop(*[f"_next_{c}" for c in cols])
    if method == "ffill":
        d = neighbours(d, s, cols, nxt=False, positions=False)
        d = d.withColumns({c: F.coalesce(F.col(c), F.col(f"_prev_{c}")) for c in cols})
        return d.drop(*[f"_prev_{c}" for c in cols])
    raise ValueError(method)


def sweep(df: DataFrame, s: Series, cols: list[str]) -> DataFrame:
    """WN16: non-finite -> null, back-fill, forward-fill, then 0, per column in row order."""
    d = _ensure_index(df, s).withColumns({c: nonfinite_to_null(c) for c in cols})
    d = neighbours(d, s, cols, positions=False)
    d = d.withColumns({c: F.coalesce(F.col(c), F.col(f"_next_{c}"),
                                     F.col(f"_prev_{c}"), F.lit(0.0)) for c in cols})
    return d.drop(*[f"_prev_{c}" for c in cols], *[f"_next_{c}" for c in cols])


def clean(df: DataFrame, s: Series, sentinel: float = SENTINEL) -> DataFrame:
    """PRJ4 then WN14/WN15 on the value column of a long table."""
    v = s.value
    return interpolate(df.withColumn(v, sentinel_to_null(v, sentinel)), s, [v])
