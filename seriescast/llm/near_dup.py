"""Operator 8, MinHash near-duplicates with odd sketches.

1. Every text becomes the set of its word shingles (64-bit hashes of the
   lower-cased words).  At most ``HASHES`` MinHash samples of the set are cut into bands
   for candidates and folded into a parity bitmap (odd sketch): each sample flips
   one bit, so the XOR of two bitmaps counts the samples in which they differ.
2. Texts with equal sets are one class, decided by a 128-bit digest of the set;
   only the class's smallest id goes on.
3. Inside a band bucket every member is paired with one centre.  Pairs whose
   bitmaps differ in more than ``sketch_limit`` bits are far below the threshold and
   dropped; the others are confirmed on the full sets.
4. Components of the confirmed links are found.  In buckets that still hold more
   than one component every member outside the bucket's main component is compared
   with the members of other components, by the bitmaps and then by wide ones
   (``WIDE_HASHES`` samples, precise to about 0.05 in similarity); pairs that pass are
   confirmed on the full sets.  So each candidate pair is either confirmed, refuted,
   or inside one component already; no bucket's pairs are listed whole, none is capped.

The shingle length and the threshold (per cent) are arguments; ``Measure`` derives the
rest from them.  The bands have as many samples as ``HASHES`` allow with a pair at the
threshold sharing no band with probability at most ``MISSED``: 32 bands of 6 at 0.85, 38
of 5 at 0.80.  The sketch limits lie five (upper bounds of the) standard deviations above
the bits that differ at the threshold: about 52 of 512, limit 104, at 0.85 and about 66,
limit 122, at 0.80; of the wide sketch about 530 of 4,096, limit 692, at 0.85.

Defined cases: null or blank text has an empty set and is linked with nothing;
fewer words than a shingle give one shingle of the whole sequence; repeated
rows (equal ids) fall into one component; empty tables give empty results;
further columns are ignored by ``classes`` and kept by ``keep_first``.  ``id_col`` must be
ordered; ``classes`` names components by it and so leaves rows of a null id without
component unless another copy has an id.  ``keep_first`` tells rows apart by id and text:
rows equal in both are one, null ids come last, further texts of an id by their digest.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriescast.llm.graph import components
from seriescast.llm.text import LOWER, Rolling, checkpointed, mix, only_ids, unused, utf8, word_hashes, written

SHINGLE = 3
THRESHOLD = 85         # per cent
HASHES = 192
MISSED = 3.1e-7        # chance that a pair at the threshold shares no band
DEVIATIONS = 5
SKETCH_BITS = 512
WIDE_HASHES, WIDE_BITS = 2048, 4096


class Measure(NamedTuple):
    """Shingle length and similarity (per cent) of near copies, and what follows from them."""

    shingle: int = SHINGLE
    threshold: int = THRESHOLD

    def _bands(self, rows: int) -> int:
        share = min(0.999, self.threshold / 100) ** rows
        return math.ceil(math.log(MISSED) / math.log(1 - share))

    @property
    def rows(self) -> int:
        """Samples of a band: the most that fit ``HASHES``."""
        return max([r for r in range(1, 17) if r * self._bands(r) <= HASHES], default=1)

    @property
    def bands(self) -> int:
        return self._bands(self.rows)

    def limit(self, hashes: int, bits: int) -> int:
        """Bits of two odd sketches that differ at the threshold, and ``DEVIATIONS`` more."""
        same = self.threshold / 100
        even = (1 - 2 / bits) ** (2 * hashes * (1 - same))
        spread = math.sqrt(bits / 4 * (1 - even ** 2) + (2 * even) ** 2 * hashes * same * (1 - same))
        return math.ceil(bits / 2 * (1 - even) + DEVIATIONS * spread)

    @property
    def sketch_limit(self) -> int:
        return self.limit(self.rows * self.bands, SKETCH_BITS)

    @property
    def wide_limit(self) -> int:
        return self.limit(WIDE_HASHES, WIDE_BITS)


_RNG = np.random.default_rng(8)
_MUL_LO = _RNG.integers(1, 1 << 31, WIDE_HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MUL_HI = _RNG.integers(1, 1 << 31, WIDE_HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SALT = mix(np.arange(1, WIDE_HASHES + 1, dtype=np.uint64))


def shingle_set(raw: bytes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    codes = np.frombuffer(raw.translate(LOWER), dtype=np.uint8)
    _, _, h = word_hashes(codes)
    n = len(h)
    if not n:
        return h
    roll = Rolling(h, 1)
    start = np.arange(max(1, n - k + 1))
    return np.unique(roll.slices(start, np.minimum(start + k, n)))


def min_hashes(values: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """``hashes`` MinHash samples of a non-empty set."""
    lo, hi = values.astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)
    out = np.full(hashes, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(values), 1024):
        part = lo[None, at: at + 1024] * _MUL_LO[:hashes, None]
        part += hi[None, at: at + 1024] * _MUL_HI[:hashes, None]
        # a linear hash alone correlates the samples: fold the high half back and multiply again
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x7FEB352D)
        np.minimum(out, part.min(axis=1), out=out)
    return out


def sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Odd sketch: the parity of the samples that fall on each bit, as int64 words."""
    bit = (mix(samples.astype(np.uint64) ^ _SALT[: len(samples)]) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(bit, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


Pass = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _signatures(measure: Measure) -> Pass:
    rows, bands_, k = measure.rows, measure.bands, measure.shingle
    hashes = rows * bands_

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, bands, bits = [], [], [], []
            for v in batch["raw"]:
                s = shingle_set(v.as_py(), k)
                n.append(len(s))
                if not len(s):
                    digest.append(None)
                    bands.append(None)
                    bits.append(None)
                    continue
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                m = min_hashes(s, hashes)
                keys = Rolling(m.astype(np.uint64), 0).slices(np.arange(0, hashes, rows), np.arange(rows, hashes + 1, rows))
                bands.append(mix(keys ^ _SALT[:bands_]).view(np.int64))
                bits.append(sketch(m))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                                              pa.array(bands, longs), pa.array(bits, longs)],
                                             names=["doc_id", "n_shingles", "digest", "bands", "bits"])

    return run


def _sets(measure: Measure) -> Pass:
    k = measure.shingle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(v.as_py(), k).view(np.int64) for v in batch["raw"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sets, pa.list_(pa.int64()))],
                                             names=["doc_id", "shingles"])

    return run


def _wide_sketches(measure: Measure) -> Pass:
    k = measure.shingle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = [sketch(min_hashes(shingle_set(v.as_py(), k), WIDE_HASHES), WIDE_BITS) for v in batch["raw"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(wide, pa.list_(pa.int64()))],
                                             names=["doc_id", "wide"])

    return run


def _differ(x: str, y: str) -> Column:
    """Bits in which two sketches differ."""
    words = [F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(SKETCH_BITS // 64)]
    out = words[0]
    for w in words[1:]:
        out = out + w
    return out


def confirm(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a < b) whose full sets reach the threshold."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - both
    return (pairs.join(right, "b").join(left, "a").where(100 * both >= threshold * union).select("a", "b"))


def _fetch_sets(text: DataFrame, ids: DataFrame, measure: Measure) -> DataFrame:
    """Shingle sets of the documents ``ids``."""
    kind = text.schema["doc_id"].dataType.simpleString()
    return only_ids(text, ids).mapInArrow(_sets(measure), f"doc_id {kind}, shingles array<long>")


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()


def links(docs: DataFrame, reps: DataFrame, measure: Measure = Measure()) -> DataFrame:
    """(node, comp) of the class representatives ``reps`` that are linked with another one."""
    threshold = measure.threshold
    # set sizes bound the similarity from above: min / max
    sizes = 100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb")
    near = _differ("xa", "xb") <= measure.sketch_limit
    seen = reps.select("doc_id", F.col("n_shingles").alias("n"), "bits")

    def with_sketch(df: DataFrame, col: str) -> DataFrame:
        return df.join(seen.select(F.col("doc_id").alias(col), F.col("n").alias(f"n{col}"), F.col("bits").alias(f"x{col}")), col)

    # a band key already holds its band; buckets of one are dropped before anything wide travels
    buckets = reps.select(F.explode("bands").alias("key"), "doc_id")
    many = (buckets.groupBy("key").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("last"))
            .where("centre <> last").select("key", "centre"))
    live = written(buckets.join(many, "key"))
    pairs = live.where("centre < doc_id").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct()
    star = written(with_sketch(with_sketch(pairs, "a"), "b").where(sizes).where(near).select("a", "b"))
    sets = written(_fetch_sets(docs, _ids(star), measure))
    edges = checkpointed(confirm(star, sets, threshold))
    comp = components(edges)

    # what the stars left open: members of a bucket outside its main component, its largest
    member = (live.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left")
              .select("key", "doc_id", F.coalesce("comp", "doc_id").alias("comp")))
    tops = (member.groupBy("key", "comp").agg(F.count("*").alias("rows")).groupBy("key")
            .agg(F.max(F.struct("rows", "comp")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1")
            .select("key", F.col("main.comp").alias("main")))
    open_ = written(member.join(tops, "key"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    wide = written(only_ids(docs, open_.select("doc_id").distinct())
                   .mapInArrow(_wide_sketches(measure), f"doc_id {kind}, wide array<long>"))
    open_ = open_.join(reps.select("doc_id", F.col("n_shingles").alias("n"), "bits", "bands"), "doc_id").join(wide, "doc_id")
    outer = open_.where("comp <> main").select("key", F.col("doc_id").alias("p"), F.col("n").alias("na"),
                                               F.col("bits").alias("xa"), F.col("comp").alias("ca"), "main",
                                               F.col("wide").alias("ya"), F.col("bands").alias("ba"))
    inner = open_.select("key", F.col("doc_id").alias("q"), F.col("n").alias("nb"), F.col("bits").alias("xb"),
                         F.col("comp").alias("cb"), F.col("wide").alias("yb"), F.col("bands").alias("bb"))
    nearer = F.aggregate(F.zip_with("ya", "yb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0),
                         lambda s, v: s + v) <= measure.wide_limit
    # two members outside the main component meet once in a bucket, and in their first bucket only
    first = F.array_min(F.array_intersect("ba", "bb")) == F.col("key")
    once = F.expr("ca <> cb AND (cb = main OR p < q)")
    rest = (outer.join(inner, "key").where(once).where(sizes).where(near).where(nearer).where(first)
            .select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())
    rest = written(rest.join(star, ["a", "b"], "left_anti"))
    if rest.isEmpty():
        return comp
    late = _fetch_sets(docs, _ids(rest).join(sets.select("doc_id"), "doc_id", "left_anti"), measure)
    found = checkpointed(confirm(rest, sets.unionByName(late), threshold))
    return comp if found.isEmpty() else components(edges.unionByName(found))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: id, set size, component (smallest id reachable) and ``kept``."""
    measure = Measure(shingle, threshold)
    read = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("raw"))
    kind = docs.schema[id_col].dataType.simpleString()
    signed = written(read.mapInArrow(
        _signatures(measure), f"doc_id {kind}, n_shingles long, digest binary, bands array<long>, bits array<long>"))
    first = written(signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep")))
    reps = written(signed.select("doc_id", "n_shingles", "bands", "bits")
                   .join(first.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"))
    comp = links(read, reps, measure)
    named = first.join(comp, first["rep"] == comp["node"], "left").select(
        "digest", F.coalesce("comp", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    cid = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", cid.alias("component_id"), (cid == F.col("doc_id")).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """One document of each component (its smallest id), all columns unchanged."""
    own = unused(docs, "_id")
    plain = docs.groupBy(id_col).agg(F.count("*").alias("n")).where(F.col(id_col).isNull() | (F.col("n") > 1)).isEmpty()
    # ids that name one row each are enough; else null ids (last) and the texts of one id need a key of their own
    key = F.col(id_col) if plain else F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"),
                                               F.md5(utf8(text_col)).alias("text"))
    keyed = docs.withColumn(own, key)
    judged = checkpointed(classes(keyed, own, text_col, threshold, shingle).select(F.col("doc_id").alias(own), "kept"))
    out = keyed.join(judged.where("NOT kept").select(own).distinct(), own, "left_anti")
    return (out if plain else out.dropDuplicates([own])).select(*docs.columns)
