"""Operator 7, LM scoring: cross-entropy difference of two matched n-gram models.

The target model is counted over the documents labelled good, the background
model over all documents.  The score rests on words (runs of anything but white
space, A-Z as a-z) under one shared vocabulary that is not capped: a unigram and a
bigram model, each interpolated with the uniform distribution over the V words of
the corpus and the end of a text,

    p(w) = (n(w) + S/(V+1)) / (N + S)      p(w | v) = (n(vw) + S/(V+1)) / (n(v) + S)

with the same S in target and background.  A text of k words has k predictions of
the first and k + 1 of the second kind (its end included); its loss is the mean of
all of them and its score the target loss minus the background loss, in bits: the
lower, the more it looks like the target.  Beside it stand the losses per symbol of
a spelling model: order 4 over 64 symbols (``SYMBOL``), at most 64^4 cells.

Log losses are sums over n-grams, so the n-gram counts of each document travel once,
to the task of the n-gram; there the counts of both models are added up and the
documents' losses leave summed per task.  No table of n-grams is collected.  N-grams
that are common in a sample of the documents (``HOT`` at most) do not travel: they are
counted per task over all documents and their losses broadcast, which bounds the
rows of one n-gram in one task.  The sample decides only the way, not the counts.

Defined cases: null or empty text has 0 symbols, blank text 0 words, and null losses
and score; without target documents the target model is uniform; an empty table gives
an empty result; repeated rows count as often as they occur; null ids are no target;
other columns are neither read nor returned.  Words are told apart by 63-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriescast.llm.text import BROADCAST_IDS, LOWER, mix, utf8, word_hashes, written

ORDER = 4
SIZE = 64
SMOOTH = 4.0           # weight of the shorter context, in counts
HOT = 200_000          # word n-grams that are counted apart, those most common in the sample
SAMPLE, LEAST = 32, 4  # every 32nd document; sampled documents that must have the n-gram
CHUNK = 1 << 21        # n-grams that a task gathers before it counts them


def _symbols() -> np.ndarray:
    out = np.full(256, 30, dtype=np.uint32)                     # other ASCII
    for b in range(26):
        out[65 + b] = out[97 + b] = b
    out[48:58] = 26
    out[[9, 10, 11, 12, 13, 32]] = 27
    out[[33, 46, 63]] = 28                                      # ! . ?
    out[[44, 58, 59]] = 29                                      # , : ;
    out[128:] = 32 + (np.arange(128, 256) & 31)
    return out


SYMBOL = _symbols()


def codes(raw: bytes) -> np.ndarray:
    """The 4-gram number ending at each symbol; the text is preceded by three spaces."""
    s = SYMBOL[np.frombuffer(b"   " + raw, dtype=np.uint8)]
    return ((s[:-3] << 18) | (s[1:-2] << 12) | (s[2:-1] << 6) | s[3:]).astype(np.uint32)


def word_grams(raw: bytes) -> np.ndarray:
    """Numbers of the words (even) and word pairs (odd) of a text, begin and end paired too."""
    w = word_hashes(np.frombuffer(raw.translate(LOWER), dtype=np.uint8))[2]
    if not len(w):
        return w
    w = w | np.uint64(1)
    end = np.zeros(1, dtype=np.uint64)
    pairs = mix(np.append(end, w) * np.uint64(0x9E3779B97F4A7C15) + np.append(w, end))
    return np.concatenate([w ^ np.uint64(1), pairs | np.uint64(1)])


def _add(grams: np.ndarray, n: np.ndarray, more: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of two tables of distinct n-grams and counts."""
    both, at = np.unique(np.concatenate([grams, more]), return_inverse=True)
    return both, np.bincount(at, weights=np.concatenate([n, m]), minlength=len(both)).astype(np.int64)


def marked(read: DataFrame, ids: DataFrame) -> DataFrame:
    """``read`` with ``t``: whether ``doc_id`` is among ``ids`` (broadcast up to ``BROADCAST_IDS``)."""
    ids = written(ids.where("doc_id IS NOT NULL").withColumn("t", F.lit(True)))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
    return read.join(ids, "doc_id", "left").withColumn("t", F.coalesce("t", F.lit(False)))


def common(read: DataFrame, most: int = HOT, sample: int = SAMPLE, least: int = LEAST) -> np.ndarray:
    """The word n-grams most common in a sample of the documents, sorted; at most ``most``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v in batch["raw"]:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(word_grams(v.as_py())).view(np.int64))], names=["gram"])

    part = read.where(F.pmod("key", F.lit(sample)) == 0).select("raw")
    top = (part.mapInArrow(run, "gram long").groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= least)
           .orderBy(F.desc("n"), "gram").limit(most).toPandas())
    return np.sort(top["gram"].to_numpy().astype(np.int64).view(np.uint64))


SPELLED, SEEN, WORD, TOTAL = range(4)


def tally(read: DataFrame, hot: np.ndarray) -> DataFrame:
    """(kind, gram, n, m) over all documents and those of the target, counted per task, then summed:
    spelling 4-grams, the word n-grams ``hot``, each distinct word, and in ``TOTAL`` words (0) and texts (1)."""
    shared = read.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        seen, total = np.zeros((2, len(known)), dtype=np.int64), np.zeros((2, 2), dtype=np.int64)
        spelled = [(np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)) for _ in range(2)]
        waiting: list[list[np.ndarray]] = [[], []]
        spelling: list[list[np.ndarray]] = [[], []]
        size = length = 0

        def rows(kind: int, grams: np.ndarray, n: np.ndarray, m: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(grams), 100_000):
                cut = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(grams[cut]), kind, dtype=np.int32)), pa.array(grams[cut].astype(np.uint64).view(np.int64)),
                     pa.array(n[cut]), pa.array(m[cut])], names=["kind", "gram", "n", "m"])

        def fold() -> Iterator[pa.RecordBatch]:
            words = []
            for t in range(2):
                if not waiting[t]:
                    continue
                g, n = np.unique(np.concatenate(waiting[t]), return_counts=True)
                waiting[t] = []
                words.append(g[(g & np.uint64(1)) == 0])
                if len(known):
                    at = np.minimum(np.searchsorted(known, g), len(known) - 1)
                    hit = known[at] == g
                    seen[t][at[hit]] += n[hit]
            words = np.unique(np.concatenate(words))
            zero = np.zeros(len(words), dtype=np.int64)
            yield from rows(WORD, words, zero, zero)

        def fold_spelling() -> None:
            for t in range(2):
                if spelling[t]:
                    g, n = np.unique(np.concatenate(spelling[t]), return_counts=True)
                    spelled[t] = _add(*spelled[t], g, n)
                    spelling[t] = []

        for batch in batches:
            for v, t in zip(batch["raw"], batch["t"].to_pylist()):
                raw = v.as_py()
                spelling[t].append(codes(raw))
                length += len(raw)
                if length > CHUNK:
                    fold_spelling()
                    length = 0
                g = word_grams(raw)
                if not len(g):
                    continue
                waiting[t].append(g)
                total[int(t)] += len(g) // 2, 1
                size += len(g)
                if size > CHUNK:
                    yield from fold()
                    size = 0
        if size:
            yield from fold()
        fold_spelling()
        for t, (g, n) in enumerate(spelled):
            yield from rows(SPELLED, g, n, t * n)
        yield from rows(SEEN, known, seen.sum(axis=0), seen[1])
        yield from rows(TOTAL, np.arange(2), total.sum(axis=0), total[1])

    out = read.select("raw", "t").mapInArrow(run, "kind int, gram long, n long, m long")
    return written(out.groupBy("kind", "gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))


def losses(grams: np.ndarray, counts: np.ndarray, vocabulary: np.ndarray, smooth: float = SMOOTH) -> np.ndarray:
    """-log2 p(last symbol | three before) of each gram under counts of the same grams,
    every order interpolated with the shorter one, down to uniform over ``vocabulary``."""
    p = np.full(len(grams), 1.0 / max(1, len(vocabulary)))
    for order in range(1, ORDER + 1):
        tail = grams & np.uint32((1 << (6 * order)) - 1)
        context = tail >> np.uint32(6)
        _, t = np.unique(tail, return_inverse=True)
        _, c = np.unique(context, return_inverse=True)
        nt = np.bincount(t, weights=counts)[t]
        nc = np.bincount(c, weights=counts)[c]
        p = (nt + smooth * p) / (nc + smooth)
    return -np.log2(p)


def _bits(pair: np.ndarray, n: np.ndarray, words: int, size: int) -> np.ndarray:
    """What one occurrence of an n-gram counted ``n`` times adds to the loss: a pair its count, a
    word its own probability and, as the context of the next pair, that pair's denominator."""
    out = -np.log2(n + SMOOTH / size)
    return out + np.where(pair, 0.0, np.log2(words + SMOOTH) + np.log2(n + SMOOTH))


def score(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = HOT,
          sample: int = SAMPLE, least: int = LEAST) -> DataFrame:
    """One row per document: n_symbols, target_loss, background_loss (spelling, bits a symbol), n_words,
    word_target_loss, word_background_loss and their difference score (bits a prediction).

    ``target`` has the ids of the documents of the target in its first column."""
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("raw"))
    # rows of equal id and text have equal results
    read = read.withColumn("key", F.xxhash64("doc_id", "raw"))
    ids = target.select(F.col(target.columns[0]).alias("doc_id")).distinct()
    flagged = marked(read, ids).select("key", "raw", "t")
    hot = common(read, most, sample, least)
    counts = tally(flagged, hot)
    size = counts.where(F.col("kind") == WORD).count() + 1
    totals = {r["gram"]: (r["m"], r["n"]) for r in counts.where(F.col("kind") == TOTAL).collect()}
    n_words, n_texts = totals.get(0, (0, 0)), totals.get(1, (0, 0))

    def of(kind: int) -> tuple[np.ndarray, list[np.ndarray]]:
        got = counts.where(F.col("kind") == kind).toPandas()  # SPELLED: at most 64^4 rows, SEEN: at most HOT
        grams = got["gram"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(grams)
        return grams[order], [got[c].to_numpy().astype(float)[order] for c in ("m", "n")]

    grams, spelled = of(SPELLED)
    grams = grams.astype(np.uint32)
    vocabulary = np.unique(grams & np.uint32(SIZE - 1))
    hot, seen = of(SEEN)
    pair = (hot & np.uint64(1)).astype(bool)
    shared = spark.sparkContext.broadcast((
        grams, *[losses(grams, c, vocabulary).astype(np.float32) for c in spelled],
        hot, *[_bits(pair, c, n_words[i], size) for i, c in enumerate(seen)]))
    begin = [float(np.log2(n + SMOOTH)) for n in n_texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, aim_loss, back_loss, known, aim_bits, back_bits = shared.value
        slot = np.zeros(SIZE ** ORDER, dtype=np.int32)
        slot[at] = np.arange(len(at))
        kept: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in list(zip(*kept))[:3]]
                + [pa.array(np.concatenate([x[3] for x in kept]), from_pandas=True)], names=["gram", "key", "c", "x"])

        for batch in batches:
            for v, key, t in zip(batch["raw"], batch["key"].to_pylist(), batch["t"].to_pylist()):
                raw = v.as_py()
                s = slot[codes(raw)]
                all_grams = word_grams(raw)
                g, c = np.unique(all_grams, return_counts=True)
                bits = [0.0, 0.0]
                if len(g):
                    bits = list(begin)
                    if len(known):
                        near = np.minimum(np.searchsorted(known, g), len(known) - 1)
                        hit = known[near] == g
                        bits = [x + float((c[hit] * y[near[hit]]).sum())
                                for x, y in zip(begin, (aim_bits, back_bits))]
                        g, c = g[~hit], c[~hit]
                # counts are positive, twice the count and the target mark; what the document has settled is negative
                done = [len(s), float(aim_loss[s].mean(dtype=np.float64)) if len(s) else 0.0,
                        float(back_loss[s].mean(dtype=np.float64)) if len(s) else 0.0, len(all_grams) // 2, *bits]
                own = mix(np.array([key], dtype=np.int64).view(np.uint64))
                kept.append((np.concatenate([g, np.repeat(own, len(done))]).view(np.int64),
                             np.full(len(g) + len(done), key, dtype=np.int64),
                             np.concatenate([2 * c + int(t), -1 - np.arange(len(done))]).astype(np.int32),
                             np.concatenate([np.full(len(g), np.nan), done])))
                size += len(kept[-1][0])
                if size > 50_000:
                    yield flush()
                    kept, size = [], 0
        if kept:
            yield flush()

    sent = flagged.mapInArrow(run, "gram long, key long, c int, x double")
    every = Window.partitionBy("gram")
    count = F.when(F.col("c") > 0, F.shiftright("c", 1)).otherwise(0)
    of_target = F.when(F.col("c") > 0, F.shiftright("c", 1) * F.col("c").bitwiseAND(1)).otherwise(0)
    added = sent.withColumn("n", F.sum(count).over(every)).withColumn("m", F.sum(of_target).over(every))

    def bits(col: str, words: int) -> Column:
        single = F.log2(F.lit(words + SMOOTH)) + F.log2(F.col(col) + F.lit(SMOOTH))
        one = F.when(F.col("gram").bitwiseAND(1) == 0, single).otherwise(0.0) - F.log2(F.col(col) + F.lit(SMOOTH / size))
        return F.sum(F.when(F.col("c") > 0, F.shiftright("c", 1) * one))

    def settled(i: int) -> Column:
        return F.max(F.when(F.col("c") == -1 - i, F.col("x")))

    per = added.groupBy("key").agg(
        F.count(F.when(F.col("c") == -1, 1)).alias("rows"), settled(0).cast("long").alias("n_symbols"),
        settled(1).alias("ta"), settled(2).alias("ba"), settled(3).cast("long").alias("n_words"),
        settled(4).alias("tw"), settled(5).alias("bw"), bits("m", n_words[0]).alias("tc"), bits("n", n_words[1]).alias("bc"))

    def mean(done: str, cold: str) -> Column:
        total = F.col(done) + F.coalesce(F.col(cold) / F.col("rows"), F.lit(0.0))
        return F.when(F.col("n_words") > 0, total / (2 * F.col("n_words") + 1))

    spelt = F.col("n_symbols") > 0
    per = per.select("key", "n_symbols", F.when(spelt, F.col("ta")).alias("target_loss"),
                     F.when(spelt, F.col("ba")).alias("background_loss"), "n_words",
                     mean("tw", "tc").alias("word_target_loss"), mean("bw", "bc").alias("word_background_loss"))
    out = read.select("doc_id", "key").join(per, "key").drop("key")
    return out.withColumn("score", F.col("word_target_loss") - F.col("word_background_loss"))
