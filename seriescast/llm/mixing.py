"""Operator 9, mixing sources to target weights: Efraimidis-Spirakis sampling.

Each document gets the key ``-ln(u) / weight``: ``u`` is uniform from a hash of
its id and ``weight`` its quality weight, so sorting a source by key is a
weighted draw without replacement.  A source whose target is ``e`` whole
passes plus a rest takes every document ``e`` times, then documents in key order
until their running size reaches the rest; of the document at the cut only the
words up to the rest are taken.

The running size is never sorted in one task: keys fall into ``bins`` ranges,
(source, bin) sums are pre-aggregated, and only the bin that holds a source's
cut is sorted.  A source that holds a third of all rows costs one bin of it.

Defined cases: null text has size 0; null source is a source of its own, last;
an empty table gives an empty result; equal ids with equal keys are ordered by
size; further columns of the input are ignored by ``mix`` and kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriescast.llm.text import checkpointed, unused, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BINS = 2048
SYMBOLS = "#*$%&|<>"


def quality_weight(text: Column, size: Column) -> Column:
    """0.1 to 1: falls with the number of markup symbols per word."""
    t = F.coalesce(text, F.lit(""))
    symbols = F.length(t) - F.length(F.translate(t, SYMBOLS, ""))
    return F.lit(1.0) - F.lit(0.9) * F.least(F.lit(1.0), symbols / F.greatest(size, F.lit(1)))


def uniform(id_col: Column) -> Column:
    """A number in (0, 1) from the id: 48 bits of its MD5."""
    bits = F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 48))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            most: int = MOST) -> DataFrame:
    """Per source (``src``, ``source_size``): its target words.

    Sources share ``share`` of all words by weight, none above ``most`` times its
    size.  In order of size per weight the sources at their bound come first:
    with the rest ``R`` of the words and ``W`` of the weights after the first
    ``k``, source ``k+1`` is at its bound when ``most * size / weight <= R / W``."""
    names = Window.orderBy(F.col("src").asc_nulls_last())
    at = (F.row_number().over(names) - 1) % len(weights)
    w = F.array(*[F.lit(float(x)) for x in weights])[at]
    s = sources.withColumn("w", w).withColumn("bound", F.col("source_size") * F.lit(float(most)))
    level = Window.orderBy(F.col("bound") / F.col("w"), F.col("src").asc_nulls_last())
    every = Window.partitionBy()
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    s = (s.withColumn("left", F.sum("source_size").over(every) * F.lit(float(share))
                      - F.coalesce(F.sum("bound").over(before), F.lit(0.0)))
         .withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
         .withColumn("full", F.col("bound") / F.col("w") <= F.col("left") / F.col("w_left")))
    # the common level of the sources below their bound is that of the first of them
    free = F.min(F.when(~F.col("full"), F.struct(F.col("bound") / F.col("w"), F.col("left") / F.col("w_left")))
                 ).over(every)["col2"]
    return (s.withColumn("target", F.when(F.col("full"), F.col("bound")).otherwise(F.col("w") * free))
            .select("src", "source_size", "target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        bins: int = BINS) -> DataFrame:
    """One row per document: id, ``size``, ``source_size``, ``target``, ``taken``, ``weight`` and the
    text's ``digest``."""
    size = F.size(words(F.col(text_col))).cast("long")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("src"), size.alias("size"),
                        F.col(text_col).alias("t"))
    keyed = checkpointed(
        sized.withColumn("weight", quality_weight(F.col("t"), F.col("size")))
        .withColumn("key", -F.log(uniform(F.col("doc_id"))) / F.col("weight"))
        # exp(-key) is in (0, 1): ascending bins hold descending exp(-key)
        .withColumn("bin", F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * bins).cast("int"))
        .withColumn("digest", F.xxhash64(F.coalesce(F.col("t"), F.lit(""))))
        .drop("t"))
    per_bin = checkpointed(keyed.groupBy("src", "bin").agg(F.sum("size").alias("bin_size")))
    goal = targets(per_bin.groupBy("src").agg(F.sum("bin_size").alias("source_size")))
    goal = (goal.withColumn("passes", F.when(F.col("source_size") > 0,
                                             F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
            .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")))
    upto = Window.partitionBy("src").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (per_bin.withColumn("before", F.coalesce(F.sum("bin_size").over(upto), F.lit(0)))
            .join(goal.withColumnRenamed("src", "src_"), F.expr("src <=> src_")).drop("src_"))
    cuts = checkpointed(cuts.select(
        F.col("src").alias("src_"), F.col("bin").alias("bin_"), "before", "source_size", "target",
        "passes", "rest",
        F.when(F.col("before") + F.col("bin_size") <= F.col("rest"), F.lit("all"))
        .when(F.col("before") >= F.col("rest"), F.lit("none")).otherwise(F.lit("cut")).alias("part")))
    rows = keyed.join(cuts, F.expr("src <=> src_ AND bin = bin_")).drop("src_", "bin_")
    inside = rows.where("part = 'cut'")
    order = Window.partitionBy("src", "bin").orderBy("key", "doc_id", "size", "digest")
    run = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    room = F.round("rest").cast("long") - F.col("before") - (run - F.col("size"))
    inside = inside.withColumn("extra", F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), room)))
    outside = rows.where("part <> 'cut'").withColumn("extra", F.when(F.col("part") == "all", F.col("size"))
                                                     .otherwise(0).cast("long"))
    return outside.unionByName(inside).select(
        "doc_id", F.col("src").alias("source"), "size", "source_size", "target",
        (F.col("passes") * F.col("size") + F.col("extra")).cast("long").alias("taken"), "weight", "digest")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents that the mix takes, with ``taken`` (words) and ``copies`` (passes over the
    document; a fraction is its first words); columns of these names are replaced.  Rows equal in
    id, text and source share one row's share."""
    docs = docs.drop("taken", "copies")
    own, src, text = (unused(docs, name) for name in ("_id", "_src", "_text"))
    got = (mix(docs, id_col, text_col, source_col).where("taken > 0")
           .groupBy(F.col("doc_id").alias(own), F.col("source").alias(src), F.col("digest").alias(text))
           .agg(F.max(F.struct("taken", (F.col("taken") / F.col("size")).alias("copies"))).alias("m"))
           .select(own, src, text, F.col("m.taken").alias("taken"), F.col("m.copies").alias("copies")))
    same = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(got, docs[id_col].eqNullSafe(got[own]) & docs[source_col].eqNullSafe(got[src])
                     & (same == got[text])).drop(own, src, text)
