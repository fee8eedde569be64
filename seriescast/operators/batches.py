"""Whole series as Arrow batches: every column of many series computed at once by numpy.

Where no series is longer than a few tasks' share (``Series.whole``), a task holds whole series in order, and
a statistic of all columns is a few array operations a batch instead of a window's row copies per column.
``in_batches`` gives a function batches that no series is cut by, with where each series starts (``Span``);
numbered rows that do not come whole and in order fail.  A task holds one batch and its longest series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from seriescast.operators.series import Series

Made = dict[str, "tuple[np.ndarray, np.ndarray | None] | pa.Array"]


@dataclass(frozen=True)
class Span:
    """Series of a batch: their first rows and the ones after their last; of every row its series and place (from 0)."""

    start: np.ndarray
    end: np.ndarray
    own: np.ndarray
    place: np.ndarray
    memo: dict = field(default_factory=dict)    # what several columns of a batch share

    def back(self, x: np.ndarray, k: int, missing: float) -> np.ndarray:
        """Of every row the value ``k`` rows before in its series (rows are the last axis)."""
        out = np.full_like(x, missing)
        if k < x.shape[-1]:
            out[..., k:] = x[..., : x.shape[-1] - k]
            np.copyto(out, missing, where=self.place < k)
        return out


def _starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """The rows whose keys differ from the row before (never the first)."""
    differs = np.zeros(max(batch.num_rows - 1, 0), dtype=bool)
    for k in keys:
        differs |= pc.not_equal(batch[k].slice(1), batch[k].slice(0, len(batch[k]) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(differs) + 1


def whole_series(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows in batches that no series is cut by."""
    held: list[pa.RecordBatch] = []

    def whole() -> Iterator[pa.RecordBatch]:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts(batch, keys)
        if held and any(held[-1][k][-1].as_py() != batch[k][0].as_py() for k in keys):
            yield from whole()
            held = []
        if len(starts):
            cut = int(starts[-1])
            held.append(batch.slice(0, cut))
            yield from whole()
            held, batch = [], batch.slice(cut)
        held.append(batch)
    if held:
        yield from whole()


def spans(batch: pa.RecordBatch, keys: list[str]) -> Span:
    start = np.concatenate([[0], _starts(batch, keys)])
    end = np.append(start[1:], batch.num_rows)
    own = np.repeat(np.arange(len(start)), end - start)
    return Span(start, end, own, np.arange(batch.num_rows) - start[own])


def matrix(batch: pa.RecordBatch, cols: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One row per column: the values (0 where null), and where they are not null."""
    ok = np.stack([batch[c].is_valid().to_numpy(zero_copy_only=False) for c in cols])
    return np.stack([(batch[c].fill_null(0.0) if batch[c].null_count else batch[c]).to_numpy(zero_copy_only=False) for c in cols]), ok


def in_batches(df: DataFrame, s: Series, make: Callable[[pa.RecordBatch, Span], Made], names: list[str],
               keep: list[str], params: list[str] | None = None) -> DataFrame:
    """``keep`` and the double columns ``names`` that ``make`` gives for whole, numbered series: values, and where they are known.
    With ``params`` one row per parameter (``param``): ``make`` gives ``<parameter><name>``.  ``at.memo["batch"]`` is the batch."""
    keys = s.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_series(batches, keys):
            at = spans(batch, keys)
            step = np.diff(batch["rn"].to_numpy())
            if (step[np.diff(at.own) == 0] <= 0).any() or (batch["rn"].to_numpy()[at.end - 1] != batch["n"].to_numpy()[at.end - 1]).any():
                raise ValueError("series do not lie whole and in order")
            at.memo["batch"] = batch
            made, kept = make(batch, at), [batch[c] for c in keep]
            for p in params or [None]:
                more = [] if p is None else [pa.repeat(p, batch.num_rows)]
                values = [made[n if p is None else p + n] for n in names]
                yield pa.RecordBatch.from_arrays([*kept, *more, *[pa.array(v, mask=None if ok is None or ok.all() else ~ok) for v, ok in values]],
                                                 names=[*keep, *(["param"] if params else []), *names])

    fields = [*[df.schema[c] for c in keep], *([T.StructField("param", T.StringType())] if params else []),
              *[T.StructField(n, T.DoubleType()) for n in names]]
    return df.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in fields]))


@dataclass(frozen=True)
class Swept:
    """WN16 (``fill.sweep``) of column ``col`` or of what ``first`` makes of it: not finite -> null, back-fill, forward-fill, 0."""

    col: str
    first: object = None

    def of(self, v: np.ndarray, ok: np.ndarray, n: np.ndarray, at: Span) -> tuple[np.ndarray, None]:
        v, ok = self.first.of(v, ok, n, at) if self.first is not None else (v, ok)
        ok = np.isfinite(v) if ok is None else ok & np.isfinite(v)
        out, i = np.where(ok, v, 0.0), np.arange(v.shape[1])
        for k in np.flatnonzero(~ok.all(axis=1)):
            gaps = np.flatnonzero(~ok[k])
            before = np.maximum.accumulate(np.where(ok[k], i, -1))[gaps]
            after = np.minimum.accumulate(np.where(ok[k], i, len(i))[::-1])[::-1][gaps]
            has_n, has_p = after < at.end[at.own[gaps]], before >= at.start[at.own[gaps]]
            out[k, gaps] = np.where(has_n, out[k, np.where(has_n, after, 0)], np.where(has_p, out[k, np.where(has_p, before, 0)], 0.0))
        return out, None


@dataclass(frozen=True)
class Season:
    """AG24 (``deviation``: WN19, the distance from it): the mean of the series' rows of one day of the year or month."""

    col: str
    order: str
    part: str       # "dayofyear" | "month"
    deviation: bool = False

    def of(self, v: np.ndarray, ok: np.ndarray, n: np.ndarray, at: Span) -> tuple[np.ndarray, np.ndarray]:
        key = (self.col, self.part)
        if key not in at.memo:
            ts = at.memo["batch"][self.order]
            part = (pc.day_of_year(ts) if self.part == "dayofyear" else pc.month(ts)).to_numpy(zero_copy_only=False)
            group = at.own * 367 + part
            got = [(np.bincount(group[k], x[k], minlength=group.max() + 1), np.bincount(group[k], minlength=group.max() + 1)) for x, k in zip(v, ok)]
            total, count = (np.stack(x)[:, group] for x in zip(*got))
            at.memo[key] = total / np.maximum(count, 1), count > 0
        mean, known = at.memo[key]
        return (v - mean, ok & known) if self.deviation else (mean, known)


@dataclass(frozen=True)
class Spell:
    """WN17 (WN18 with ``wet``): days since the last wet (dry) day, 0 on one (``spells.spells``)."""

    col: str
    wet: bool = False

    def of(self, v: np.ndarray, ok: np.ndarray, n: np.ndarray, at: Span) -> tuple[np.ndarray, None]:
        rn = at.memo["batch"]["rn"].to_numpy()
        ends = (ok & ~(v <= 0)) != self.wet     # NaN counts as more than 0, as in Spark
        last = np.maximum.accumulate(np.where(ends, np.arange(v.shape[1]), -1), axis=1)
        return np.where(ends, 0.0, rn - np.where(last >= at.start[at.own], rn[np.maximum(last, 0)], 0)), None


@dataclass(frozen=True)
class FirstYear:
    """The year of the series' first row."""

    col: str
    order: str

    def of(self, v: np.ndarray, ok: np.ndarray, n: np.ndarray, at: Span) -> tuple[np.ndarray, None]:
        year = pc.year(at.memo["batch"][self.order]).to_numpy(zero_copy_only=False).astype(float)
        return year[at.start[at.own]][None, :], None
