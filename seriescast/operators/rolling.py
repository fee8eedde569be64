"""Trailing windows on halo blocks (WN1-WN11, WN20).

Every frame is trailing and includes the current row; ``min_periods`` is 1
unless said.  A stage maps names to either ``fn(window) -> Column`` (lags,
differences) or a ``Rolling`` statistic; ``trailing`` evaluates stages in order (a later
stage may read an earlier one's column), all over one block window, so that Spark plans
one exchange and one sort for the whole set.

Rolling statistics are doubling merges.  The state of a frame of ``a + b`` rows is the merge
of the last ``a`` rows' state with that of the ``b`` rows before them, read with ``lag``; frames
are reached from single rows by doubling (and a step of one where needed), each frame
building on the shorter ones.  That is O(log k) merges per row for all frames together, where a sliding
frame recomputes each aggregate over k rows.  Counts, means and central moments are merged
pairwise, never subtracted, so a storm leaves no trace in the digits of later frames.
Every merge is its own small projection between two windows, which keeps the generated
methods short enough for the JIT.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriescast.operators.batches import Span, in_batches, matrix
from seriescast.operators.series import UNB_PRE, Series, block_window, index_rows, with_halo

Expr = Callable[[Window], Column]


@dataclass(frozen=True)
class Rolling:
    """A statistic of column ``col`` over the trailing frame of ``k`` rows; nulls are not counted."""

    col: str
    k: int
    stat: str       # "mean" | "std" | "min" | "max" | "sum" | "skew" | "kurt"


Stage = dict[str, "Expr | Rolling"]

# the fields of a state that each statistic reads; n is always there
NEEDS = {"sum": ("s",), "mean": ("s",), "std": ("m", "m2"), "skew": ("m", "m2", "m3"),
         "kurt": ("m", "m2", "m3", "m4"), "min": ("lo",), "max": ("hi",)}
FIELDS = ("n", "s", "m", "m2", "m3", "m4", "lo", "hi")


def trailing(df: DataFrame, s: Series, stages: list[Stage], halo: int,
             block_rows: int | None = None) -> DataFrame:
    """Evaluate ``stages`` of trailing expressions; ``halo`` must cover the longest look-back.

    A frame that already lies in blocks (``with_halo``: ``_blk``, ``_own``) stays in them and keeps ``_blk``."""
    d = df if "rn" in df.columns and "n" in df.columns else index_rows(df, s)
    blocked = "_own" in df.columns
    if not blocked:
        d = with_halo(d, s, halo, block_rows)
    w = block_window(s)
    for stage in stages:
        rolling: dict[str, dict[str, Rolling]] = {}
        for name, e in stage.items():
            if isinstance(e, Rolling):
                rolling.setdefault(e.col, {})[name] = e
        for col, wanted in rolling.items():     # first, while the frame is narrow
            d = _doubling(d, w, col, wanted)
        d = d.withColumns({name: e(w) for name, e in stage.items() if not isinstance(e, Rolling)})
    helpers = [c for c in d.columns if c.startswith("__")]
    return d.where(F.col("_own")).drop(*([] if blocked else ["_blk"]), "_own", *helpers)


def trailing_days(wide: DataFrame, s: Series, stages: list[Stage], cols: list[str], long: bool = False,
                  alone: Stage | None = None) -> DataFrame:
    """``trailing`` over every column of ``cols``, named ``value`` in ``stages``, of a frame of whole series in
    batches (``Series.batches``): adds ``<column><name>`` and evaluates the same merges on arrays.  Stages hold
    ``Rolling`` statistics and what has ``of`` (``batchable``): lags, differences, ``ewm.Ewm``.  With ``long``
    a row per column, named in ``param``.  ``alone`` has columns made from the one column that each of its expressions
    names (also in place of that column)."""
    alone = alone or {}
    names = [n for stage in stages for n in stage]

    def make(batch: pa.RecordBatch, at: Span) -> dict:
        n, have = batch["n"].to_numpy(), {"value": matrix(batch, cols)}
        with np.errstate(all="ignore"):
            for stage in stages:
                for col in dict.fromkeys(e.col for e in stage.values()):
                    rolling = {name: e for name, e in stage.items() if isinstance(e, Rolling) and e.col == col}
                    have |= _doubled(*have[col], at, rolling) if rolling else {}
                    have |= {name: e.of(*have[col], n, at) for name, e in stage.items() if e.col == col and name not in rolling}
            single = {}
            for name, e in alone.items():
                v, ok = matrix(batch, [e.col])
                single[name] = _doubled(v, ok, at, {name: e})[name] if isinstance(e, Rolling) else e.of(v, ok, n, at)
        made = {f"{c}{name}": (have[name][0][i], None if have[name][1] is None else have[name][1][i])
                for i, c in enumerate(cols) for name in names}
        return made | {name: (v[0], None if ok is None else ok[0]) for name, (v, ok) in single.items()}

    if long:
        return in_batches(wide, s, make, names, [*s.k, s.order], cols)
    made = [*[f"{c}{name}" for c in cols for name in names], *alone]
    return in_batches(wide, s, make, made, [c for c in wide.columns if c != "_tb" and c not in alone])


def batchable(stages: list[Stage]) -> bool:
    return all(isinstance(e, Rolling) or hasattr(e, "of") for stage in stages for e in stage.values())


def _doubled(v: np.ndarray, ok: np.ndarray, at: Span, wanted: dict[str, Rolling]) -> dict:
    """``_doubling`` on arrays: the same chain of merges over all columns at once; values and where they are known."""
    need = {f for r in wanted.values() for f in NEEDS[r.stat]}
    fields = ["n", *[f for f in FIELDS[1:] if f in need]]
    steps = _chain({r.k for r in wanted.values()})
    missing = {"lo": np.nan, "hi": -np.inf}     # least passes over it, and n tells it from a value
    filled = np.where(ok, v, 0.0)
    alone = {"n": np.ones((1, ok.shape[1])) if ok.all() else ok.astype(float), "s": filled, "m": filled,
             "lo": np.where(ok, v, np.nan), "hi": np.where(ok, v, -np.inf)}
    held, out = {1: {f: alone[f] if f in alone else np.zeros_like(filled) for f in fields}}, {}
    for i, (a, b) in enumerate([(1, 0), *steps]):
        if b:
            earlier = {f: at.back(x, a, missing.get(f, 0.0)) for f, x in held[b].items()}
            held[a + b] = _merged(earlier, held[a], np.fmin, np.maximum, 1.0)
        out |= {name: _known(held[a + b], r.stat, v.shape) for name, r in wanted.items() if r.k == a + b}
        later = {x for step in steps[i:] for x in step}
        held = {k: x for k, x in held.items() if k in later}
    return out


def _known(state: dict, stat: str, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray | None]:
    """``_statistic`` on arrays, and where it is known (None: everywhere)."""
    n = np.broadcast_to(state["n"], shape)
    if stat in ("min", "max", "sum", "mean"):
        x = state[{"min": "lo", "max": "hi"}.get(stat, "s")]
        return (x / np.where(n > 0, n, 1.0) if stat == "mean" else x), n > 0
    m2 = state["m2"]
    if stat == "std":
        return np.where(n > 1, np.sqrt(m2 / (n - 1)), 0.0), None
    spread = ~(m2 <= 0)     # NaN counts as more than 0, as in Spark
    if stat == "skew":
        g1 = np.sqrt(n) * state["m3"] / (m2 * np.sqrt(m2))
        return np.where((n >= 3) & spread, g1 * np.sqrt(n * (n - 1)) / (n - 2), 0.0), None
    g2 = n * state["m4"] / (m2 * m2) - 3.0
    return np.where(n < 4, 0.0, np.where(spread, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6), -3.0)), None


def _chain(frames: set[int]) -> list[tuple[int, int]]:
    """(a, b) steps that reach every frame as ``a + b`` rows from earlier ones, starting at one row."""
    known, steps = {1}, []

    def reach(k: int) -> None:
        if k in known:
            return
        a = max((x for x in known if k - x in known and x >= k - x), default=0)
        if not a:
            a = k // 2 if k % 2 == 0 else k - 1
            reach(a)
        known.add(k)
        steps.append((a, k - a))

    for k in sorted(frames):
        reach(k)
    return steps


def _merged(a: dict, b: dict, least=F.least, greatest=F.greatest, one=None) -> dict:
    """The state of two disjoint sets of rows; terms that several fields share are evaluated once
    by Spark's subexpression elimination.  Columns, or arrays with numpy's functions."""
    out = {"n": a["n"] + b["n"]}
    if "s" in a:
        out["s"] = a["s"] + b["s"]
    if "lo" in a:
        out["lo"] = least(a["lo"], b["lo"])
    if "hi" in a:
        out["hi"] = greatest(a["hi"], b["hi"])
    if "m" not in a:
        return out
    n = greatest(out["n"], F.lit(1.0) if one is None else one)
    p, q, d = a["n"] / n, b["n"] / n, b["m"] - a["m"]
    t = d * d * (a["n"] * q)
    out["m"] = a["m"] + d * q
    out["m2"] = a["m2"] + b["m2"] + t
    if "m3" in a:
        out["m3"] = a["m3"] + b["m3"] + t * d * (p - q) + 3.0 * d * (p * b["m2"] - q * a["m2"])
    if "m4" in a:
        out["m4"] = (a["m4"] + b["m4"] + t * d * d * (p * p - p * q + q * q)
                     + 6.0 * d * d * (p * p * b["m2"] + q * q * a["m2"]) + 4.0 * d * (p * b["m3"] - q * a["m3"]))
    return out


def _statistic(state: dict[str, Column], stat: str) -> Column:
    """Null over a frame without values."""
    n = state["n"]
    if stat in ("min", "max"):
        return state["lo" if stat == "min" else "hi"]
    some = F.when(n > 0, n)
    if stat == "sum":
        return F.when(n > 0, state["s"])
    if stat == "mean":
        return state["s"] / some
    m2 = state["m2"]
    if stat == "std":       # sample std; a single row becomes 0
        return F.when(n > 1, F.sqrt(m2 / (n - 1))).otherwise(F.lit(0.0))
    if stat == "skew":      # WN4: adjusted G1; fewer than 3 rows or a constant frame -> 0
        g1 = F.sqrt(n) * state["m3"] / (m2 * F.sqrt(m2))
        return F.when((n >= 3) & (m2 > 0), g1 * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(F.lit(0.0))
    # WN5: adjusted excess G2; fewer than 4 rows -> 0, a constant frame -> -3
    g2 = n * state["m4"] / (m2 * m2) - 3.0
    return (F.when(n < 4, F.lit(0.0)).when(m2 > 0, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
             .otherwise(F.lit(-3.0)))


def _doubling(d: DataFrame, w: Window, col: str, wanted: dict[str, Rolling]) -> DataFrame:
    """All rolling statistics of one column: its frames one after the other, a state leaving the
    rows once no later frame builds on it."""
    need = {f for r in wanted.values() for f in NEEDS[r.stat]}
    fields = ["n", *[f for f in FIELDS[1:] if f in need]]
    steps = _chain({r.k for r in wanted.values()})
    tag = f"__{col}_"

    def state(k: int | str) -> dict[str, Column]:
        return {f: F.col(f"{tag}{k}{f}") for f in fields}

    def named(k: int | str, columns: dict[str, Column]) -> list[Column]:
        return [c.alias(f"{tag}{k}{f}") for f, c in columns.items()]

    v, has = F.col(col).cast("double"), F.col(col).isNotNull()
    one = {"n": F.lit(1.0), "s": v, "m": v, "lo": v, "hi": v}
    zero = {f: None if f in ("lo", "hi") else 0.0 for f in fields}
    alone = {f: F.lit(0.0) if f not in one else v if zero[f] is None else F.when(has, one[f]).otherwise(F.lit(0.0))
             for f in fields}
    kept = d.columns
    d = d.select(*kept, *named(1, alone))
    held = [1]
    for i, (a, b) in enumerate([*steps, (0, 0)]):
        # what the last step's frame reports, and the earlier state that this step adds
        told = {name: _statistic(state(r.k), r.stat) for name, r in wanted.items() if r.k == held[-1]}
        later = {x for step in steps[i:] for x in step}
        held = [k for k in held if k in later]
        moved = [F.lag(c, a, zero[f]).over(w).alias(f"{tag}l{f}") for f, c in state(b).items()] if a else []
        d = d.select(*kept, *[c.alias(name) for name, c in told.items()], *[c for k in held for c in state(k).values()], *moved)
        kept = [*kept, *told]
        if a:
            d = d.select(*kept, *[c for k in held for c in state(k).values()],
                         *named(a + b, _merged(state("l"), state(a))))
            held.append(a + b)
    return d


def mean(c: str, k: int) -> Rolling:
    return Rolling(c, int(k), "mean")


def std(c: str, k: int) -> Rolling:
    """Sample std; a single row becomes 0."""
    return Rolling(c, int(k), "std")


def vmin(c: str, k: int) -> Rolling:
    return Rolling(c, int(k), "min")


def vmax(c: str, k: int) -> Rolling:
    return Rolling(c, int(k), "max")


def vsum(c: str, k: int) -> Rolling:
    return Rolling(c, int(k), "sum")


def skew(c: str, k: int) -> Rolling:
    """WN4: bias-adjusted G1 over the frame; fewer than 3 rows or a constant frame -> 0."""
    return Rolling(c, int(k), "skew")


def kurt(c: str, k: int) -> Rolling:
    """WN5: bias-adjusted excess G2; fewer than 4 rows -> 0, a constant frame -> -3."""
    return Rolling(c, int(k), "kurt")


def moment_stages(c: str, windows: list[int], which: tuple[str, ...] = ("skew", "kurt"),
                  prefix: str | None = None) -> list[Stage]:
    """WN4 + WN5 for windows of 7 rows or more."""
    p = prefix if prefix is not None else c
    makers = {"skew": skew, "kurt": kurt}
    return [{f"{p}_rolling_{st}_{k}": makers[st](c, k) for k in windows if k >= 7 for st in ("skew", "kurt") if st in which}]


@dataclass(frozen=True)
class lag_bfill:
    """WN7: value ``k`` rows back; leading rows take the series' first value.

    A series of ``k`` rows or fewer has no value to back-fill from and stays null (``or0``: 0)."""

    col: str
    k: int
    or0: bool = False

    def __call__(self, w: Window) -> Column:
        first = F.first(self.col).over(w.rowsBetween(UNB_PRE, 0))
        got = F.coalesce(F.lag(self.col, int(self.k)).over(w), F.when(F.col("n") > int(self.k), first))
        return F.coalesce(got, F.lit(0.0)) if self.or0 else got

    def of(self, v: np.ndarray, ok: np.ndarray, n: np.ndarray, at: Span) -> tuple[np.ndarray, np.ndarray]:
        first = at.start[at.own]
        got = np.flatnonzero(at.place >= self.k)
        src = first.copy()
        src[got] = got - self.k
        value, known = v[:, src], ok[:, src]
        lost = ~known & ok[:, first] & (n > self.k)     # as coalesce: a null that many rows back takes the first value too
        value, known = np.where(lost, v[:, first], value), (known & ((at.place >= self.k) | (n > self.k))) | lost
        return (np.where(known, value, 0.0), np.ones_like(known)) if self.or0 else (value, known)


@dataclass(frozen=True)
class diff:
    """WN8 (0-filled) / WN9 (left null)."""

    col: str
    k: int
    fill0: bool = True

    def __call__(self, w: Window) -> Column:
        d = F.col(self.col) - F.lag(self.col, int(self.k)).over(w)
        return F.coalesce(d, F.lit(0.0)) if self.fill0 else d

    def of(self, v: np.ndarray, ok: np.ndarray, n: np.ndarray, at: Span) -> tuple[np.ndarray, np.ndarray]:
        known = ok & at.back(ok, self.k, False)
        d = v - at.back(v, self.k, 0.0)
        return (np.where(known, d, 0.0), np.ones_like(known)) if self.fill0 else (d, known)


@dataclass(frozen=True)
class pct_change:
    """WN10 before the sweep: no look-back row or 0/0 -> 0; x/0 -> NULL (infinite)."""

    col: str
    k: int

    def __call__(self, w: Window) -> Column:
        prev = F.lag(self.col, int(self.k)).over(w)
        v = F.col(self.col)
        return (F.when(prev.isNull() | ((prev == 0) & (v == 0)), F.lit(0.0))
                 .when(prev == 0, F.lit(None).cast("double"))
                 .otherwise(F.try_divide(v, prev) - 1))

    def of(self, v: np.ndarray, ok: np.ndarray, n: np.ndarray, at: Span) -> tuple[np.ndarray, np.ndarray]:
        prev, has = at.back(v, self.k, 0.0), at.back(ok, self.k, False)
        flat = ~has | ((prev == 0) & ok & (v == 0))
        return np.where(flat, 0.0, v / np.where(prev == 0, 1.0, prev) - 1), flat | (ok & (prev != 0))


def rolling_stats(c: str, windows: list[int], stats: tuple[str, ...] = ("mean", "std", "min", "max"),
                  prefix: str | None = None) -> Stage:
    """The reference's column names: ``<p>_rolling_<k>``, ``_rolling_std_``, ``_rolling_min_`` ..."""
    p = prefix if prefix is not None else c
    makers = {"mean": ("rolling", mean), "std": ("rolling_std", std), "min": ("rolling_min", vmin),
              "max": ("rolling_max", vmax), "sum": ("rolling_sum", vsum),
              "skew": ("rolling_skew", skew), "kurt": ("rolling_kurt", kurt)}
    out: Stage = {}
    for k in windows:
        for st in stats:
            label, mk = makers[st]
            if st in ("skew", "kurt") and k < 7:
                continue
            out[f"{p}_{label}_{k}"] = mk(c, k)
    return out
