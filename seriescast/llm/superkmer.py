"""Super-k-mers: consecutive windows that share a minimiser, over words or bytes.

A window is ``window`` consecutive tokens.  Its minimiser is the smallest hash of
its ``gram``-token grams, so equal windows have equal minimisers.  A maximal run
of windows with one minimiser is a super-k-mer: ``nwin`` windows packed in
``nwin + window - 1`` tokens.  Equal windows can only meet under one minimiser.

A row is known by ``doc_id`` and ``part``: a hash of the text where ids are null or repeated,
0 where every id names one row (``keyed``).

Only hashes travel at first: ``anchors_in_common`` keeps the super-k-mers whose
minimiser occurs elsewhere too.  The packed strings of those (one per distinct
string) are then fetched from the texts and dealt out by minimiser.

A minimiser with more than ``HOT`` distinct strings is not gathered in one task:
its windows are spread over all tasks by their own 128-bit digests and
aggregated there (``split_hot`` gives the two parts).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriescast.llm.text import Rolling, checkpointed, sliding_min, utf8, written

SLAB = 1 << 18         # window starts handled at once; runs are cut there
HOT = 4000             # distinct strings of one minimiser that one task sorts
CHUNK = 1 << 20        # bytes of packed strings sorted at once


class Segments(NamedTuple):
    start: np.ndarray
    nwin: np.ndarray
    anchor: np.ndarray
    digest: np.ndarray
    again: np.ndarray  # the run may hold one window twice


def segments(codes: np.ndarray, second: np.ndarray, window: int, gram: int) -> Segments:
    """Super-k-mers of a token sequence given as two independent code arrays."""
    parts = []
    for at in range(0, len(codes) - window + 1, SLAB):
        c = codes[at: at + SLAB + window - 1]
        i = np.arange(len(c) - gram + 1)
        grams = Rolling(c, 0).slices(i, i + gram)
        low = sliding_min(grams, window - gram + 1)
        same = low[1:] == low[:-1]
        start = np.concatenate([[0], np.flatnonzero(~same) + 1])
        nwin = np.diff(np.append(start, len(low)))
        # the anchor leaves a window at its left and the next window has it again
        back = np.concatenate([[0], np.cumsum((grams[: len(low) - 1] == low[:-1]) & same), [0]])
        again = back[start + nwin - 1] > back[start]
        digest = Rolling(second[at: at + SLAB + window - 1], 1).slices(start, start + nwin + window - 1)
        parts.append(Segments(start + at, nwin, low[start].view(np.int64), digest.view(np.int64), again))
    if not parts:
        z = np.zeros(0, dtype=np.int64)
        return Segments(z, z, z, z, z.astype(bool))
    return Segments(*[np.concatenate(x) for x in zip(*parts)])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, part, raw).  Ids are counted first; where one is null or names several rows, ``part``
    tells its texts apart (equal rows stay together, which changes nothing: they lose the same)."""
    ids = docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).where("id IS NULL OR n > 1")
    part = F.lit(0).cast("long") if ids.isEmpty() else F.xxhash64(F.lit(text_col), F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), part.alias("part"), utf8(text_col).alias("raw"))


def scan(docs: DataFrame, find: Callable[[bytes], Segments], id_kind: str) -> DataFrame:
    """(doc_id, part, anchor, digest, start, nwin, again) of every super-k-mer of ``docs`` (doc_id, part, raw)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, got, size = [], [], 0
            for i, v in enumerate(batch["raw"]):
                s = find(v.as_py())
                if len(s.start):
                    rows.append(np.full(len(s.start), i))
                    got.append(s)
                    size += len(s.start)
                if size > 200_000:
                    yield pack(batch, rows, got)
                    rows, got, size = [], [], 0
            if got:
                yield pack(batch, rows, got)

    def pack(batch: pa.RecordBatch, rows: list, got: list) -> pa.RecordBatch:
        s = Segments(*[np.concatenate(x) for x in zip(*got)])
        at = pa.array(np.concatenate(rows))
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"].take(at), batch["part"].take(at), pa.array(s.anchor), pa.array(s.digest), pa.array(s.start.astype(np.int32)),
             pa.array(s.nwin.astype(np.int32)), pa.array(s.again)],
            names=["doc_id", "part", "anchor", "digest", "start", "nwin", "again"])

    return docs.mapInArrow(run, f"doc_id {id_kind}, part long, anchor long, digest long, start int, nwin int, again boolean")


def anchors_in_common(found: DataFrame, common: Column) -> DataFrame:
    """The super-k-mers whose minimiser passes the aggregate ``common``; minimisers
    are counted with map-side combine, then joined back."""
    shared = (found.groupBy("anchor").agg(common.alias("ok")).where("ok").select(F.col("anchor").alias("a")))
    return written(found.join(shared, F.expr("anchor = a"), "left_semi"))


def fetch(docs: DataFrame, wanted: DataFrame, cut: Callable[[bytes, list], list[bytes]]) -> DataFrame:
    """(anchor, digest, rank, packed) of the ``wanted`` super-k-mers
    (doc_id, part, anchor, digest, rank, start, nwin), cut from their texts."""
    per_doc = wanted.groupBy(F.col("doc_id").alias("_id"), F.col("part").alias("_part")).agg(F.collect_list(F.struct("anchor", "digest", "rank", "start", "nwin")).alias("want"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, want in zip(batch["raw"], batch["want"]):
                want = want.as_py()
                for at in range(0, len(want), 20_000):
                    some = want[at: at + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array([w[c] for w in some], pa.int64()) for c in ("anchor", "digest", "rank")],
                         pa.array(cut(raw.as_py(), [(w["start"], w["nwin"]) for w in some]), pa.binary())],
                        names=["anchor", "digest", "rank", "packed"])

    return (docs.join(per_doc, F.expr("doc_id <=> _id AND part = _part")).select("raw", "want")
            .mapInArrow(run, "anchor long, digest long, rank long, packed binary"))


def split_hot(strings: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """The strings of ordinary and of hot minimisers."""
    big = (strings.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot)
           .select(F.col("anchor").alias("a")))
    big = checkpointed(big)
    return (strings.join(big, F.expr("anchor = a"), "left_anti"), strings.join(big, F.expr("anchor = a"), "left_semi"))


def in_buckets(strings: DataFrame, judge: Callable[[list[tuple[int, int, int, bytes]]], list[list[tuple[int, int]]]],
               chunk: int = CHUNK) -> DataFrame:
    """Deal the strings out by minimiser and judge whole minimisers at a time, about
    ``chunk`` bytes together.  ``judge`` maps (anchor, digest, rank, packed) rows to
    lists of window ranges; returns (anchor, digest, at) with non-empty ranges ``at``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, bytes]] = []
        size, last = 0, None
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns]):
                if size > chunk and r[0] != last:
                    yield judged(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[3])
                last = r[0]
        if rows:
            yield judged(rows)

    def judged(rows: list) -> pa.RecordBatch:
        got = [(r[0], r[1], x) for r, x in zip(rows, judge(rows)) if x]
        return pa.RecordBatch.from_arrays(
            [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()),
             pa.array([[{"a": a, "b": b} for a, b in g[2]] for g in got], pa.list_(RANGE))],
            names=["anchor", "digest", "at"])

    return (strings.select("anchor", "digest", "rank", "packed").repartition("anchor").sortWithinPartitions("anchor")
            .mapInArrow(run, RESULT))


RANGE = pa.struct([("a", pa.int32()), ("b", pa.int32())])
RESULT = "anchor long, digest long, at array<struct<a:int,b:int>>"


def by_window(strings: DataFrame, windows: Callable[[bytes], list[bytes]], verdict: Column,
              aggregates: list[Column]) -> DataFrame:
    """Hot minimisers: every window of every string under its 16-byte digest, the
    digests aggregated over all tasks, ``verdict`` true for the windows to mark;
    returns (anchor, digest, at) like ``in_buckets``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, d, r, s in zip(*[c.to_pylist() for c in batch.columns]):
                keys = windows(s)
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a] * n, pa.int64()), pa.array([d] * n, pa.int64()), pa.array([r] * n, pa.int64()),
                     pa.array(range(n), pa.int32()), pa.array(keys, pa.binary())],
                    names=["anchor", "digest", "rank", "i", "key"])

    rows = checkpointed(strings.select("anchor", "digest", "rank", "packed").mapInArrow(
        run, "anchor long, digest long, rank long, i int, key binary"))
    seen = rows.groupBy("key").agg(*aggregates).withColumnRenamed("key", "k")
    marked = rows.join(seen, F.expr("key = k")).where(verdict)
    return (marked.groupBy("anchor", "digest")
            .agg(F.array_sort(F.collect_list(F.struct(F.col("i").alias("a"), (F.col("i") + 1).alias("b")))).alias("at")))


def ranges_by_doc(live: DataFrame, marks: DataFrame, window: int) -> DataFrame:
    """(doc_id, part, spans): token ranges covered by marked windows, per document.
    ``marks``: (anchor, digest, at) with ``at`` null for all windows of a string."""
    m = marks.select(F.col("anchor").alias("ma"), F.col("digest").alias("md"), "at")
    hit = live.join(m, F.expr("anchor = ma AND digest = md"))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("nwin").alias("b")))
    spans = F.transform(F.coalesce("at", whole), lambda r: F.struct(
        (F.col("start") + r["a"]).alias("a"), (F.col("start") + r["b"] + F.lit(window - 1)).alias("b")))
    return (hit.select("doc_id", "part", spans.alias("s")).groupBy("doc_id", "part")
            .agg(F.flatten(F.collect_list("s")).alias("spans")))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, raw, spans) of every row; null where nothing is covered."""
    spans = spans.withColumnsRenamed({"doc_id": "_id", "part": "_part"})
    return docs.join(spans, F.expr("doc_id <=> _id AND part = _part"), "left").select("doc_id", "raw", "spans")
