"""Series layout: positions, halo blocks and carries.

A series is the set of rows sharing ``keys`` (by default ``site, param``),
ordered by ``order``.  The reference works on one site held in memory, in file
order; here every operator names the order and never puts a whole series into
one task:

* ``index_rows`` numbers the rows of every series (``rn``, 1-based) and adds the
  series length ``n``.  Rows are counted per coarse time bucket (a year by
  default), bucket offsets come from a running sum over the small count table,
  and ``row_number`` only runs inside one (series, bucket).
* ``with_halo`` cuts a series into blocks of ``block_rows`` rows and copies the
  ``halo`` rows before each block into it, so that every trailing window or lag
  that looks back at most ``halo`` rows is computed inside one block.  The copy
  costs ``halo / block_rows`` extra rows.
* ``neighbours`` gives, for each row, the last non-null value at or before it
  and the first non-null value at or after it, anywhere in the series: inside a
  block by a running window, across blocks by a running window over the small
  per-block summary table (one row per block), joined back.

* ``index_neighbours`` does both for a frame without numbers, from one summary per time
  bucket (``carries``), and persists nothing; ``fill.interpolate`` does the same for double columns,
  with the summary and the rows reading one exchange.

Several columns of one frame can be series of the same positions: ``dealt`` names the keys that
such a frame was shuffled on.  It is unpivoted inside the tasks, and windows over ``keys`` and
the block find their rows together without another shuffle; a carry is dealt out the same way.
``parts`` (``task_parts``) is the number of tasks, in proportion to the rows, so that the rows
one task sorts do not grow with the table.  Where no series has more rows than ``WHOLE_TASKS`` such tasks (the longest is
counted first, ``evaluate.days_series``), ``whole`` deals a series out unbroken: it is numbered, filled
and read back on by windows in the task where it lies, after a single shuffle, without halos and carries.
With ``batches`` too the same is done column by column on Arrow batches of whole series (``operators.batches``).

Other operators that branch (a small summary aggregated from a frame and joined back
to it) persist the frame they branch on, so its upstream - a file scan and
aggregation - runs once.  The persisted frames have a deterministic lineage
(positions are ordered by ``order``), so a lost executor's blocks are simply
recomputed.

Keys are assumed non-null; rows without a key or a time bucket are left out when numbered.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

UNB_PRE = Window.unboundedPreceding
UNB_FOL = Window.unboundedFollowing


@dataclass(frozen=True)
class Series:
    """How a long table is cut into series."""

    keys: tuple[str, ...] = ("site", "param")
    order: str = "ts"
    value: str = "value"
    block_rows: int = 4096          # rows per block for halo windows and carries
    bucket: str | None = None       # SQL expression, non-decreasing in ``order``
    dealt: tuple[str, ...] | None = None    # with the block, the keys a blocked frame was shuffled on
    parts: int | None = None        # tasks of such a shuffle; None leaves it to Spark
    whole: bool = False             # no series is longer than a few tasks' share: dealt out on ``dealt`` alone, one block each
    batches: bool = False           # with ``whole``: cleaned and read back on as Arrow batches of whole series (``batches``)

    def with_keys(self, *keys: str) -> "Series":
        return replace(self, keys=tuple(keys))

    def with_blocks(self, block_rows: int) -> "Series":
        return replace(self, block_rows=block_rows)

    @property
    def k(self) -> list[str]:
        return list(self.keys)

    def bucket_col(self) -> Column:
        if self.whole:
            return F.when(F.col(self.order).isNotNull(), F.lit(0))
        return F.expr(self.bucket) if self.bucket else F.year(F.col(self.order))


def reused(df: DataFrame) -> DataFrame:
    """Persist a frame that two branches of one plan read."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


SMALL_ROWS = 100_000
TASK_ROWS = 50_000      # rows with one column per parameter that one task sorts
WHOLE_TASKS = 4         # a series of up to this many tasks' rows is dealt out unbroken


def task_parts(spark: SparkSession, rows: int) -> int | None:
    """Tasks for ``rows`` rows, or None where Spark's own number of partitions keeps them small."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = -(-rows // TASK_ROWS)
    return max(parts, least) if parts > 10 * WHOLE_TASKS else None


def spread(df: DataFrame, s: Series, *by: str) -> DataFrame:
    """The rows dealt out to ``s.parts`` tasks by the hash of ``by``."""
    return df.repartition(s.parts, *by) if s.parts else df.repartition(*by)


def join_carry(d: DataFrame, carry: DataFrame, s: Series, blk: str) -> DataFrame:
    """``carry`` (one row per series and block) joined to the rows of its block, on the left.

    Rows that were dealt out stay where they are: Spark shuffles both sides of a join on more keys than
    they lie by, so the carries of a dealt block's series are put in one row and looked up in it.
    A series of one block gets nothing from others."""
    if s.whole:
        return d.withColumns({c: F.lit(None).cast(carry.schema[c].dataType) for c in carry.columns if c not in (*s.k, blk)})
    more = [k for k in s.keys if k not in (s.dealt or s.keys)]
    if s.dealt:
        carry = spread(carry, s, *s.dealt, blk)
    if not more:
        return d.join(carry, [*s.k, blk], "left")
    cols = [c for c in carry.columns if c not in (*s.k, blk)]
    entry = F.struct(F.struct(*more).alias("k"), F.struct(*cols).alias("v"))
    packed = carry.groupBy(*s.dealt, blk).agg(F.map_from_entries(F.collect_list(entry)).alias("_of"))
    got = d.join(packed, [*s.dealt, blk], "left").withColumn("_of", F.try_element_at("_of", F.struct(*more)))
    return got.select(*d.columns, *[F.col("_of")[c].alias(c) for c in cols])


def small_side(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """The small side of a join: a table with one row per parameter, model, feature or day.

    Its rows are counted (it is persisted first, so it is computed once); up to ``limit``
    rows of a few numbers each it is broadcast, so that the large side is not shuffled on a
    key with ten values.  A larger one is returned as it is, for an ordinary join."""
    d = reused(df)
    return F.broadcast(d) if d.count() <= limit else d


def index_rows(df: DataFrame, s: Series) -> DataFrame:
    """Add ``rn`` (1-based position in the series) and ``n`` (series length)."""
    keys = s.k
    d = reused(df.withColumn("_tb", s.bucket_col()))
    counts = d.groupBy(*keys, "_tb").agg(F.count(F.lit(1)).alias("_c"))
    wk = Window.partitionBy(*keys).orderBy("_tb")
    offs = counts.select(
        *keys, "_tb",
        F.coalesce(F.sum("_c").over(wk.rowsBetween(UNB_PRE, -1)), F.lit(0)).alias("_off"),
        F.sum("_c").over(Window.partitionBy(*keys)).alias("n"),
    )
    d = d.join(offs, keys + ["_tb"])
    rn = F.col("_off") + F.row_number().over(
        Window.partitionBy(*keys, "_tb").orderBy(s.order))
    # ``_tb`` stays: carries (``neighbours``) use the time buckets as their blocks, so
    # they run on the partitioning and sort order this window already produced
    return d.withColumn("rn", rn.cast("long")).drop("_off", "_c")


def carries(summ: DataFrame, s: Series, cols: list[str]) -> DataFrame:
    """What each time bucket of a series gets from the others, from one row per bucket: ``_c`` rows and, of
    every column, the last and first value and its place in the bucket (``_blv_``, ``_blr_``, ``_bfv_``, ``_bfr_``).

    Adds up the rows before (``_off``) and of the series (``n``), and finds the last value and position before
    (``_pinv_``, ``_pinr_``) and the first after (``_ninv_``, ``_ninr_``)."""
    keys, buckets = s.k, [*s.k, "_tb"]
    fwd = Window.partitionBy(*keys).orderBy("_tb").rowsBetween(UNB_PRE, -1)
    bwd = Window.partitionBy(*keys).orderBy(F.col("_tb").desc()).rowsBetween(UNB_PRE, -1)
    summ = summ.withColumns({"_off": F.coalesce(F.sum("_c").over(fwd), F.lit(0)),
                             "n": F.sum("_c").over(Window.partitionBy(*keys))})
    return summ.select(*buckets, "_off", "n", *[e for c in cols for e in (
        F.last(f"_blv_{c}", ignorenulls=True).over(fwd).alias(f"_pinv_{c}"),
        F.last(F.col(f"_blr_{c}") + F.col("_off"), ignorenulls=True).over(fwd).alias(f"_pinr_{c}"),
        F.last(f"_bfv_{c}", ignorenulls=True).over(bwd).alias(f"_ninv_{c}"),
        F.last(F.col(f"_bfr_{c}") + F.col("_off"), ignorenulls=True).over(bwd).alias(f"_ninr_{c}"))])


def index_neighbours(df: DataFrame, s: Series, cols: list[str]) -> DataFrame:
    """``index_rows`` and ``neighbours`` (with positions) of a frame that has neither yet.

    One row per series and time bucket holds its number of rows and the first and last value and
    place of every column; running windows over that small table give offsets, length and carries.
    Rows of the same ``order`` are placed by their values, so both branches number them alike."""
    keys, buckets = s.k, [*s.k, "_tb"]
    d = df if "_tb" in df.columns else df.withColumn("_tb", s.bucket_col())
    w = Window.partitionBy(*buckets).orderBy(s.order, *cols)
    d = d.dropna(subset=keys).withColumn("_at", F.row_number().over(w).cast("long"))
    # rows without a time count in offsets and length, and carry nothing
    at = {c: F.when(F.col(c).isNotNull() & F.col("_tb").isNotNull(), F.col("_at")) for c in cols}
    summ = d.groupBy(*buckets).agg(F.count(F.lit(1)).alias("_c"), *[e for c in cols for e in (
        F.max_by(c, at[c]).alias(f"_blv_{c}"), F.max(at[c]).alias(f"_blr_{c}"),
        F.min_by(c, at[c]).alias(f"_bfv_{c}"), F.min(at[c]).alias(f"_bfr_{c}"))])
    carry = carries(summ, s, cols)
    wf = w.rowsBetween(UNB_PRE, 0)
    wb = Window.partitionBy(*buckets).orderBy(F.col("_at").desc()).rowsBetween(UNB_PRE, 0)
    for side, win in (("p", wf), ("n", wb)):
        d = d.withColumns({k: v for c in cols for k, v in (
            (f"_{side}wv_{c}", F.last(c, ignorenulls=True).over(win)),
            (f"_{side}wr_{c}", F.last(at[c], ignorenulls=True).over(win)))})
    d = join_carry(d, carry, s, "_tb").where(F.col("_tb").isNotNull())
    out = {"rn": F.col("_at") + F.col("_off")}
    for c in cols:
        for side, name in (("p", f"_prev_{c}"), ("n", f"_next_{c}")):
            here = F.col(f"_{side}wr_{c}")
            out[name] = (F.when(here.isNotNull(), F.struct((here + F.col("_off")).alias("r"), F.col(f"_{side}wv_{c}").alias("v")))
                          .when(F.col(f"_{side}inr_{c}").isNotNull(),
                                F.struct(F.col(f"_{side}inr_{c}").alias("r"), F.col(f"_{side}inv_{c}").alias("v"))))
    kept = [c for c in df.columns if c != "_tb"]
    return d.withColumns(out).select(*kept, "_tb", "n", "rn", *[x for c in cols for x in (f"_prev_{c}", f"_next_{c}")])


def with_halo(df: DataFrame, s: Series, halo: int, block_rows: int | None = None) -> DataFrame:
    """Explode rows into their own block (``_own``) and the blocks whose halo they are in.

    Needs ``rn`` and ``n``.  Adds ``_blk`` and ``_own``; windows then run over
    ``block_window(s)`` and the caller keeps ``_own`` rows.
    """
    b = int(block_rows or s.block_rows)
    halo = int(halo)
    own = F.expr(f"(rn - 1) div {b}")
    last = F.least(F.expr(f"(rn - 1 + {halo}) div {b}"), F.expr(f"(n - 1) div {b}"))
    return (df.withColumn("_ownblk", own)
              .withColumn("_blk", F.explode(F.sequence(own, last)))
              .withColumn("_own", F.col("_blk") == F.col("_ownblk"))
              .drop("_ownblk"))


def block_window(s: Series, desc: bool = False) -> Window:
    order = F.col("rn").desc() if desc else F.col("rn")
    return Window.partitionBy(*s.k, "_blk").orderBy(order)


def neighbours(df: DataFrame, s: Series, cols: list[str], prev: bool = True,
               nxt: bool = True, block_rows: int | None = None,
               positions: bool = True) -> DataFrame:
    """For each column ``c`` add ``_prev_c`` / ``_next_c``: the last non-null value at
    or before the row and the first non-null at or after it, anywhere in the series.
    With ``positions`` they are ``struct(r, v)`` (``r`` = its ``rn``), else plain values.

    Needs ``rn``.  Blocks are the time buckets of ``index_rows`` when present (same
    partitioning and order as the numbering window: no new shuffle), else blocks of
    ``block_rows`` rows; carries over blocks come from a window over the per-block
    summary, which holds one row per block.  Running ``last(..., ignorenulls)`` over
    scalar columns keeps the windows allocation-free.
    """
    keys = s.k
    if s.dealt and "_blk" in df.columns:    # blocks as dealt out: no shuffle, and nothing persisted
        d, order = df, F.col("rn")
    elif "_tb" in df.columns and block_rows is None:
        d, order = reused(df.withColumn("_blk", F.col("_tb"))), F.col(s.order)
    else:
        b = int(block_rows or s.block_rows)
        d, order = reused(df.withColumn("_blk", F.expr(f"(rn - 1) div {b}"))), F.col("rn")
    blk = "_blk"
    rn_if = {c: F.when(F.col(c).isNotNull(), F.col("rn")) for c in cols}
    aggs = []
    for c in cols:
        if prev:
            aggs.append(F.max_by(c, rn_if[c]).alias(f"_blv_{c}"))
            if positions:
                aggs.append(F.max(rn_if[c]).alias(f"_blr_{c}"))
        if nxt:
            aggs.append(F.min_by(c, rn_if[c]).alias(f"_bfv_{c}"))
            if positions:
                aggs.append(F.min(rn_if[c]).alias(f"_bfr_{c}"))
    summ = d.groupBy(*keys, blk).agg(*aggs)
    fwd = Window.partitionBy(*keys).orderBy(blk).rowsBetween(UNB_PRE, -1)
    bwd = Window.partitionBy(*keys).orderBy(F.col(blk).desc()).rowsBetween(UNB_PRE, -1)
    carry_cols = []
    for c in cols:
        for side, win, tag in (("p", fwd, "bl"), ("n", bwd, "bf")):
            if (side == "p" and not prev) or (side == "n" and not nxt):
                continue
            carry_cols.append(F.last(f"_{tag}v_{c}", ignorenulls=True).over(win).alias(f"_{side}inv_{c}"))
            if positions:
                carry_cols.append(F.last(f"_{tag}r_{c}", ignorenulls=True).over(win).alias(f"_{side}inr_{c}"))
    carry = summ.select(*keys, blk, *carry_cols)
    d = join_carry(d, carry, s if "_blk" in df.columns else replace(s, dealt=None), blk)
    wf = Window.partitionBy(*keys, blk).orderBy(order).rowsBetween(UNB_PRE, 0)
    wb = Window.partitionBy(*keys, blk).orderBy(order.desc()).rowsBetween(UNB_PRE, 0)
    inner = {}
    for c in cols:
        for side, win in (("p", wf), ("n", wb)):
            if (side == "p" and not prev) or (side == "n" and not nxt):
                continue
            inner[f"_{side}wv_{c}"] = F.last(c, ignorenulls=True).over(win)
            if positions:
                inner[f"_{side}wr_{c}"] = F.last(rn_if[c], ignorenulls=True).over(win)
    d = d.withColumns(inner)
    out = {}
    for c in cols:
        for side, name in (("p", f"_prev_{c}"), ("n", f"_next_{c}")):
            if (side == "p" and not prev) or (side == "n" and not nxt):
                continue
            wv, cv = F.col(f"_{side}wv_{c}"), F.col(f"_{side}inv_{c}")
            if positions:
                wr, cr = F.col(f"_{side}wr_{c}"), F.col(f"_{side}inr_{c}")
                out[name] = (F.when(wr.isNotNull(), F.struct(wr.alias("r"), wv.alias("v")))
                              .when(cr.isNotNull(), F.struct(cr.alias("r"), cv.alias("v"))))
            else:
                out[name] = F.coalesce(wv, cv)
    d = d.withColumns(out)
    helpers = [x for x in d.columns if x[:4] in ("_pwv", "_pwr", "_nwv", "_nwr", "_pin", "_nin")]
    return d.drop(*helpers, *([] if "_blk" in df.columns else ["_blk"]))
