"""Operator 2, substring dedup: super-k-mer partitioning over words.

A window is 50 consecutive words.  A word goes when a window that covers it also
starts in a document with a smaller id.  Identical super-k-mers are settled by
the smallest id that has them (aggregated before any shuffle); the distinct
strings of a shared minimiser travel packed to its bucket, where sorting the
windows gives each the smallest id that has it.

Defined cases: null or empty text has no words, removes nothing and keeps the
empty string; rows of equal ids do not remove each other's words, and each is cut by its own text's
windows (texts of one id are told apart by a 64-bit hash); null ids come after all others, so
they remove no other document's words and count as equal; empty tables give empty results; columns besides id and text are
neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriescast.llm import superkmer as S
from seriescast.llm.text import checkpointed, covered, runs, word_hashes, written

WINDOW = 50
GRAM = 8
LAST = (1 << 63) - 1     # the rank of null ids


def _find(raw: bytes) -> S.Segments:
    codes = np.frombuffer(raw, dtype=np.uint8)
    _, _, h = word_hashes(codes, 0)
    second = h if len(h) < WINDOW else word_hashes(codes, 1)[2]
    return S.segments(h, second, WINDOW, GRAM)


def _cut(raw: bytes, at: list[tuple[int, int]]) -> list[bytes]:
    ws = raw.split()
    return [b" ".join(ws[s: s + n + WINDOW - 1]) for s, n in at]


def _windows(packed: bytes) -> list[bytes]:
    ws = packed.split(b" ")
    cuts = np.cumsum([0, *[len(w) + 1 for w in ws]]).tolist()
    return [packed[cuts[i]: cuts[i + WINDOW] - 1] for i in range(len(ws) - WINDOW + 1)]


def _digests(packed: bytes) -> list[bytes]:
    return [hashlib.blake2b(w, digest_size=16).digest() for w in _windows(packed)]


def _judge(rows: list[tuple[int, int, int, bytes]]) -> list[list[tuple[int, int]]]:
    """Sort all windows; equal ones stand together, the smallest id first."""
    every = sorted((w, r[2], k, i) for k, r in enumerate(rows) for i, w in enumerate(_windows(r[3])))
    marks: list[list[int]] = [[] for _ in rows]
    head, first = None, None
    for w, rank, k, i in every:
        if w != head:
            head, first = w, rank
        elif rank > first:
            marks[k].append(i)
    out = []
    for r, m in zip(rows, marks):
        if m:
            flags = np.zeros(max(m) + 1, dtype=bool)
            flags[m] = True
            out.append([(int(a), int(b)) for a, b in zip(*runs(flags))])
        else:
            out.append([])
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_words, n_removed, kept_text, spans (word ranges removed).
    Ids must be integers (their order decides which copy stays)."""
    read = S.keyed(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    found = written(S.scan(read, _find, kind))
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    live = S.anchors_in_common(found, F.min(rank) < F.max(rank))
    distinct = written(live.groupBy("anchor", "digest").agg(
        F.min(F.struct(rank.alias("rank"), "doc_id", "part", "start", "nwin")).alias("f"), F.max(rank).alias("last")))
    # a minimiser with a single string needs no look inside
    several = (distinct.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select(F.col("anchor").alias("a")))
    wanted = distinct.join(several, F.expr("anchor = a"), "left_semi").select(
        "f.doc_id", "f.part", "anchor", "digest", "f.rank", "f.start", "f.nwin")
    strings = written(S.fetch(read, wanted, _cut))
    usual, hot = S.split_hot(strings)
    parts = S.in_buckets(usual, _judge).unionByName(
        S.by_window(hot, _digests, F.expr("rank > first"), [F.min("rank").alias("first")]))
    parts = checkpointed(parts)
    # the first document of a string loses the windows that others have earlier, later ones the whole string
    firsts = distinct.select(F.col("anchor").alias("a"), F.col("digest").alias("d"), F.col("f.rank").alias("first"), "last")
    ranked = live.withColumn("rank", rank)
    of_first = S.ranges_by_doc(ranked.join(firsts, F.expr("anchor = a AND digest = d AND rank = first"), "left_semi"),
                               parts, WINDOW)
    later = ranked.join(firsts.where("first < last"), F.expr("anchor = a AND digest = d AND rank > first"), "left_semi")
    of_later = later.groupBy("doc_id", "part").agg(F.collect_list(F.struct(
        F.col("start").alias("a"), (F.col("start") + F.col("nwin") + F.lit(WINDOW - 1)).alias("b"))).alias("spans"))
    spans = (of_first.unionByName(of_later).groupBy("doc_id", "part").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    return remove(read, spans, kind)


def remove(read: DataFrame, spans: DataFrame, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept, left = [], [], [], []
            for raw, at in zip(batch["raw"], batch["spans"]):
                ws = raw.as_py().split()
                at = at.as_py()
                n.append(len(ws))
                if not at:
                    gone.append(0)
                    left.append([])
                    kept.append(b" ".join(ws))
                    continue
                flags = covered(len(ws), np.array([x["a"] for x in at]), np.array([x["b"] for x in at]))
                gone.append(int(flags.sum()))
                kept.append(b" ".join([w for w, f in zip(ws, flags.tolist()) if not f]))
                left.append([{"a": int(a), "b": int(b)} for a, b in zip(*runs(flags))])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()),
                 pa.array(left, pa.list_(S.RANGE))], names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    return (S.with_spans(read, spans).mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept binary, spans array<struct<a:int,b:int>>")
            .withColumn("kept_text", F.col("kept").cast("string")).drop("kept"))
