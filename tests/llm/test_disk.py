"""Intermediates leave the disk when nothing reads them any more."""

import os

from pyspark.sql import functions as F

from seriescast.llm import suffix_dedup
from seriescast.llm.text import CLEANUP, unwritten, written
from seriescast.session import ensure_checkpoint_dir


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}


def test_a_written_tables_shuffles_go(spark):
    before = _shuffle_files(spark)
    set_before = spark.conf.get(CLEANUP, None)
    got = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert sorted(r["k"] for r in got.collect()) == list(range(7))
    assert _shuffle_files(spark) <= before
    assert spark.conf.get(CLEANUP, None) == set_before
    unwritten(got)
    assert not [f for f in got.inputFiles() if os.path.exists(f.removeprefix("file:").replace("///", "/"))]


def test_suffix_dedup_keeps_only_its_spans(spark):
    top = ensure_checkpoint_dir(spark).removeprefix("file:")
    tables = lambda: {x for x in os.listdir(top) if x.startswith("written-")}
    line = "".join(chr(97 + (i * i) % 23) + str(i) for i in range(150))
    docs = spark.createDataFrame([("a", line + " one end"), ("b", "other start " + line), ("c", "short"), (None, None)], "doc_id string, text string")
    before = tables()
    out = suffix_dedup.dedup(docs)
    assert len(tables() - before) == 1
    got = {r["doc_id"]: r["n_removed"] for r in out.collect()}
    assert got == {"a": len(line), "b": len(line), "c": 0, None: 0}
