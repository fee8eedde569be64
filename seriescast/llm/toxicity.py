"""Operator 4, toxicity: non-negative positive-unlabelled learning.

Features are the hashed words of a text and their beginnings (3 to 8 characters),
each present or not.  A linear classifier is trained in numpy on confirmed toxic
documents P and unlabelled documents U with the class-prior-corrected risk

    prior * R_P(toxic) + max(0, R_U(clean) - prior * R_P(clean))

whose second part is kept non-negative: where it falls below zero its gradient is
reversed.  Scoring is one pass over all documents.

Both sets hold distinct texts, so copies weigh nothing in them, and the prior is
the share of toxic ones among the distinct labelled texts (toxic if any label of a copy
says so).  The fit uses at most ``MAX_POSITIVE`` confirmed and ``MAX_UNLABELLED`` unlabelled
texts, those with the smallest hashes of their ids; these two parameters
bound what is collected and broadcast.  Documents held out (``crc32(id) % 5 = 0``)
are in neither set.

U holds toxic texts too: the share of a feature among clean texts is estimated as
``(share in U - prior * share in P) / (1 - prior)``, and features are chosen by their share
in P over that, whatever the prior.

Defined cases: null or empty text has no features and gets the score of the
intercept; without confirmed examples every score is 0; repeated label rows count
as one (toxic if any says so); empty tables give empty results; label, language,
source and id are no features; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriescast.llm.decontaminate import NORMAL
from seriescast.llm.text import BYTE_CODES, Rolling, utf8, word_bounds, written

DIMENSIONS = 1 << 20
PREFIXES = (3, 4, 5, 6, 7, 8)
MAX_POSITIVE = 4000
MAX_UNLABELLED = 12_000
FOLDS = 5
LEAST = 6              # confirmed documents, copies included, that must have a feature (fewer of under 300: 1 in 50)
LIFT = 3.0             # how much likelier it must be in P than in clean texts
STEPS, RATE, DECAY = 300, 0.1, 1e-4


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0


def occurrences(raw: bytes) -> np.ndarray:
    """Feature numbers of a text, repeats included."""
    codes = np.frombuffer(raw.translate(NORMAL), dtype=np.uint8)
    start, end = word_bounds(codes)
    if not len(start):
        return np.zeros(0, dtype=np.int32)
    roll = Rolling(BYTE_CODES[0][codes])
    parts = [roll.slices(start, end)]
    letters = np.append(np.flatnonzero((codes & 0xC0) != 0x80), len(codes))  # byte offsets of the characters
    first = np.searchsorted(letters, start)
    for k in PREFIXES:
        upto = letters[np.minimum(first + k, len(letters) - 1)]
        longer = upto < end
        parts.append(roll.slices(start[longer], upto[longer]) + np.uint64(k << 50))
    return (np.concatenate(parts) >> np.uint64(44)).astype(np.int32)


def features(raw: bytes) -> np.ndarray:
    """Distinct feature numbers of a text."""
    return np.unique(occurrences(raw))


def nn_pu(rows: list[np.ndarray], positive: np.ndarray, prior: float,
          copies: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights (dense over ``DIMENSIONS``) and intercept, by full-batch Adam on the nnPU risk
    with the logistic loss; ``copies`` are the documents of each text."""
    copies = np.ones(len(rows), dtype=np.int64) if copies is None else copies
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    in_p, in_u = np.zeros(DIMENSIONS, dtype=np.int32), np.zeros(DIMENSIONS, dtype=np.int32)
    having = np.zeros(DIMENSIONS, dtype=np.int64)
    for r, p, c in zip(rows, positive, copies):
        (in_p if p else in_u)[r] += 1
        if p:
            having[r] += c
    in_p, in_u = in_p / max(1, n_p), in_u / max(1, n_u)
    least = min(LEAST, max(1, int(copies[positive].sum()) // 50))
    clean = np.maximum(0.0, in_u - prior * in_p) / (1 - prior)
    use = (having >= least) & (in_p >= LIFT * clean)
    column = np.cumsum(use) - 1
    cols = [column[r[use[r]]] for r in rows]
    at = np.repeat(np.arange(len(rows)), [len(c) for c in cols])
    col = np.concatenate(cols) if cols else np.zeros(0, dtype=np.int64)
    width = int(use.sum())
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    theta = np.append(w, b)
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    clean_loss = lambda z: np.logaddexp(0, z)
    share_p = np.where(positive, prior / max(1, n_p), 0.0)
    share_u = np.where(positive, 0.0, 1.0 / max(1, n_u))
    for step in range(1, STEPS + 1):
        z = np.bincount(at, weights=theta[col], minlength=len(rows)) + theta[-1]
        s = sig(z)
        clean = (share_u * clean_loss(z)).sum() - (share_p * clean_loss(z)).sum()
        if clean >= 0:
            g = share_p * (s - 1) + share_u * s - share_p * s
        else:
            g = share_p * s - share_u * s
        grad = np.append(np.bincount(col, weights=g[at], minlength=width), g.sum())
        grad[:-1] += DECAY * theta[:-1]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        theta = theta - RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    out = np.zeros(DIMENSIONS)
    out[use] = theta[:-1]
    return out, float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> tuple[np.ndarray, float] | None:
    """Fit on the training side; None without confirmed toxic documents."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    marks = marks.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    raw = utf8(text_col)
    ids = docs.select(F.col(id_col).alias("id"), F.xxhash64(raw).alias("text")).where("id IS NOT NULL")
    ids = ids.where(~held_out(F.col("id")))
    # one row per distinct text of the training side; the document with the smallest hash stands for it
    texts = written(ids.join(marks, "id", "left").groupBy("text")
                    .agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id")).alias("one"), F.max("y").alias("y"),
                         F.count("*").alias("copies")).select("one.h", "one.id", "y", "copies"))
    stats = texts.agg(F.avg("y").alias("prior"), F.sum("y").alias("n")).first()
    if not stats["n"]:
        return None
    order = ["h", "id"]
    p = texts.where("y = 1").orderBy(*order).limit(MAX_POSITIVE).select("id", "copies")
    u = texts.orderBy(*order).limit(MAX_UNLABELLED).select("id", "copies")  # all texts, as the risk estimator assumes
    # at most MAX_POSITIVE + MAX_UNLABELLED ids
    chosen = p.withColumn("p", F.lit(True)).unionByName(u.withColumn("p", F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["id"], batch["p"], batch["copies"], pa.array([features(v.as_py()) for v in batch["raw"]],
                                                                                pa.list_(pa.int32()))], names=["id", "p", "copies", "f"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = (docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("raw")).join(F.broadcast(chosen), "id")
            .select("id", "p", "copies", "raw").mapInArrow(run, f"id {kind}, p boolean, copies long, f array<int>")
            .toArrow().sort_by("id"))
    seen = [np.asarray(v.values, dtype=np.int32) for v in rows["f"]]
    prior = min(1 - 1e-4, max(1e-4, float(stats["prior"])))
    return nn_pu(seen, np.array(rows["p"].to_pylist(), dtype=bool), prior, rows["copies"].to_numpy())


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> DataFrame:
    """One row per document: held_out, score in [0, 1], predicted."""
    model = train(docs, labels, id_col, text_col, label_col)
    weights, bias = model if model else (np.zeros(DIMENSIONS), -np.inf)
    used = np.flatnonzero(weights).astype(np.int32)
    shared = docs.sparkSession.sparkContext.broadcast((used, weights[used].astype(np.float32)))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(DIMENSIONS, dtype=np.float32)
        table[shared.value[0]] = shared.value[1]

        def weigh(raw: bytes) -> float:
            f = occurrences(raw)
            return float(table[np.unique(f[table[f] != 0])].sum(dtype=np.float64))

        for batch in batches:
            z = np.array([weigh(v.as_py()) for v in batch["raw"]]) + bias
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))],
                                             names=["doc_id", "score"])

    out = (docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("raw"))
           .mapInArrow(run, f"doc_id {kind}, score double"))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
