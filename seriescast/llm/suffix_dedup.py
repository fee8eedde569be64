"""Operator 10, suffix-array dedup: two-stage suffix sorting over bytes.

A byte goes when a 200-byte string that covers it also starts anywhere else, in
the same document or another.  Super-k-mers of bytes bring together the places
where equal 200-byte strings can be; identical ones are settled by counting them
before any shuffle.  The distinct strings under a shared minimiser are joined to
one text per task, whose suffixes are sorted in two stages: only those smaller
than their successor are sorted directly (by their first 200 bytes), the others
are induced by one scan over the first-byte buckets.  Neighbours with a common
prefix of 200 bytes are repeats.

Defined cases: null or empty text has no bytes, removes nothing and keeps the
empty string; equal rows are copies of each other and lose their repeats; rows with equal or
null ids are different places, each cut by its own text's repeats (they are told apart by a
64-bit hash of the text); empty tables give empty results; columns besides id and text are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriescast.llm import superkmer as S
from seriescast.llm.text import BYTE_CODES, covered, runs, unwritten, written

WINDOW = 200
GRAM = 16


def _find(raw: bytes) -> S.Segments:
    if len(raw) < WINDOW:
        raw = b""
    codes = np.frombuffer(raw, dtype=np.uint8)
    if len(codes) <= S.SLAB:
        return S.segments(BYTE_CODES[0][codes], BYTE_CODES[1][codes], WINDOW, GRAM)
    parts = []
    for at in range(0, len(codes) - WINDOW + 1, S.SLAB):  # the codes of a very long text are 16 times its size
        c = codes[at: at + S.SLAB + WINDOW - 1]
        s = S.segments(BYTE_CODES[0][c], BYTE_CODES[1][c], WINDOW, GRAM)
        parts.append(s._replace(start=s.start + at))
    return S.Segments(*[np.concatenate(x) for x in zip(*parts)])


def _cut(raw: bytes, at: list[tuple[int, int]]) -> list[bytes]:
    return [raw[s: s + n + WINDOW - 1] for s, n in at]


def _digests(packed: bytes) -> list[bytes]:
    return [hashlib.blake2b(packed[i: i + WINDOW], digest_size=16).digest() for i in range(len(packed) - WINDOW + 1)]


def words8(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian number (zeros after the end)."""
    out = np.zeros(len(text) + 8, dtype=np.uint64)
    pad = np.concatenate([text, np.zeros(15, dtype=text.dtype)]).astype(np.uint64)
    for k in range(8):
        out |= pad[k: k + len(out)] << np.uint64(56 - 8 * k)
    return out[: len(text)]


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last position counts as smaller."""
    step = np.sign(np.diff(text.astype(np.int16)))
    nxt = np.where(step != 0, np.arange(len(step)), len(step))
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]  # equal bytes: decided where the run ends
    return np.append(np.append(step, 1)[nxt] > 0, True)


def sort_direct(at: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their first ``depth`` bytes, eight at a time, ties only."""
    order = at[np.argsort(keys[at], kind="stable")]
    group = np.concatenate([[True], keys[order][1:] != keys[order][:-1]]) if len(order) else np.zeros(0, bool)
    for off in range(8, depth, 8):
        # rows whose key equals a neighbour's are still tied
        tied = np.flatnonzero(~group | np.append(~group[1:], False))
        if not len(tied):
            break
        k = keys[np.minimum(order[tied] + off, len(keys) - 1)]
        gid = np.cumsum(group[tied])
        new = np.lexsort((k, gid))
        order[tied] = order[tied][new]
        k = k[new]
        group[tied[1:]] |= k[1:] != k[:-1]
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All positions in the order of their first ``depth`` bytes or more.

    ``text`` holds byte values + 1 as uint16; 0 ends each string."""
    small = smaller_than_next(text)
    bytes8 = words8(np.maximum(text, 1) - 1)
    direct = sort_direct(np.flatnonzero(small), bytes8, depth)
    # direct positions by first byte, in order
    first = text[direct]
    by = np.argsort(first, kind="stable")
    direct, first = direct[by], first[by]
    bounds = np.searchsorted(first, np.arange(258))
    larger: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    for c in range(257):
        wave = np.concatenate(larger[c]) if larger[c] else direct[:0]
        got = []
        while len(wave):  # a larger suffix before another with the same byte follows it in the same bucket
            got.append(wave)
            wave = wave[wave > 0] - 1
            wave = wave[text[wave] == c]
        bucket = np.concatenate([*got, direct[bounds[c]: bounds[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]
        if len(before):
            f = text[before]
            by = np.argsort(f, kind="stable")
            before, f = before[by], f[by]
            cut = np.flatnonzero(np.diff(f)) + 1
            for part in np.split(before, cut):
                larger[text[part[0]]].append(part)
    return np.concatenate(out)


def repeats(strings: list[bytes], window: int = WINDOW) -> list[np.ndarray]:
    """Per string, flags of the window starts whose ``window`` bytes also start elsewhere in ``strings``."""
    size = np.array([len(s) for s in strings])
    starts = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    text = np.zeros(int(size.sum()) + len(strings), dtype=np.uint16)
    valid = np.zeros(len(text), dtype=bool)
    for s, at in zip(strings, starts):
        text[at: at + len(s)] = np.frombuffer(s, dtype=np.uint8).astype(np.uint16) + 1
        valid[at: at + len(s) - window + 1] = len(s) >= window
    sa = suffix_array(text, window)
    sa = sa[valid[sa]]
    keys = words8(np.maximum(text, 1) - 1)
    same = np.arange(len(sa) - 1) if len(sa) else np.zeros(0, dtype=np.int64)
    for off in [*range(0, window - 7, 8), window - 8]:  # adjacent common prefix of at least ``window`` bytes
        same = same[keys[sa[same] + off] == keys[sa[same + 1] + off]]
    flags = np.zeros(len(text), dtype=bool)
    flags[sa[same]] = True
    flags[sa[same + 1]] = True
    return [flags[at: at + max(0, n - window + 1)] for at, n in zip(starts, size)]


def _judge(rows: list[tuple[int, int, int, bytes]]) -> list[list[tuple[int, int]]]:
    return [[(int(a), int(b)) for a, b in zip(*runs(f))] if f.any() else [] for f in repeats([r[3] for r in rows])]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_bytes, n_removed, kept (bytes), spans (byte ranges removed)."""
    read = S.keyed(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    found = written(S.scan(read, _find, kind))
    live = S.anchors_in_common(found, (F.count("*") > 1) | F.max("again"))
    unwritten(found)
    distinct = written(live.groupBy("anchor", "digest").agg(
        F.min(F.struct("doc_id", "part", "start", "nwin")).alias("f"), F.count("*").alias("n"), F.max("again").alias("again")))
    # only strings that occur once, under a minimiser with other strings, need a look inside
    open_ = (distinct.groupBy("anchor").agg(F.count("*").alias("k"), F.min("n").alias("least"), F.max("again").alias("g"))
             .where("least = 1 AND (k > 1 OR g)").select(F.col("anchor").alias("a")))
    wanted = distinct.join(open_, F.expr("anchor = a"), "left_semi").select(
        "f.doc_id", "f.part", "anchor", "digest", F.lit(0).cast("long").alias("rank"), "f.start", "f.nwin")
    strings = written(S.fetch(read, wanted, _cut))
    usual, hot = S.split_hot(strings)
    parts = S.in_buckets(usual, _judge).unionByName(
        S.by_window(hot, _digests, F.expr("times > 1"), [F.count("*").alias("times")]))
    many = distinct.where("n > 1").select("anchor", "digest", F.lit(None).cast("array<struct<a:int,b:int>>").alias("at"))
    once = parts.join(many.select(F.col("anchor").alias("a"), F.col("digest").alias("d")),
                      F.expr("anchor = a AND digest = d"), "left_anti")
    spans = written(S.ranges_by_doc(live, once.unionByName(many), WINDOW))
    unwritten(live, distinct, strings)      # before the texts are shuffled to their spans
    return remove(read, spans, kind)


def remove(read: DataFrame, spans: DataFrame, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept, left = [], [], [], []
            for raw, at in zip(batch["raw"], batch["spans"]):
                raw, at = raw.as_py(), at.as_py()
                n.append(len(raw))
                if not at:
                    gone.append(0)
                    left.append([])
                    kept.append(raw)
                    continue
                flags = covered(len(raw), np.array([x["a"] for x in at]), np.array([x["b"] for x in at]))
                gone.append(int(flags.sum()))
                kept.append(np.frombuffer(raw, dtype=np.uint8)[~flags].tobytes())
                left.append([{"a": int(a), "b": int(b)} for a, b in zip(*runs(flags))])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()),
                 pa.array(left, pa.list_(S.RANGE))], names=["doc_id", "n_bytes", "n_removed", "kept", "spans"])

    return S.with_spans(read, spans).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, kept binary, spans array<struct<a:int,b:int>>")
