"""What the pipeline leaves on disk."""

from __future__ import annotations

import corpus_pipeline as pipeline
from fleetlens.llm.common import land, land_last
from fleetlens.workspace import new_dir, shared_dir

from .test_operators import SF_DIR


def folders(spark):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return {file.getPath().getName() for file in listed}


def test_line_dedup_leaves_only_its_decisions(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = folders(spark)
    kept = pipeline.line_dedup(spark, docs, SF_DIR)
    left = folders(spark) - before
    assert len(left) == 1 and left.pop().startswith("pipeline-lines-")
    assert 0 < kept.count() <= docs.count()


def test_land_last_keeps_what_was_there_before(spark):
    own = land(spark.range(5), "cost-own")

    def make():
        new_dir(spark, "cost-never-written")
        inner = land_last(lambda: land(own.filter("id > 1"), "cost-a").filter("id > 2"), spark, "cost-b")
        return land(inner, "cost-c").unionByName(own)
    before = folders(spark)
    assert sorted(row.id for row in land_last(make, spark, "cost-out").collect()) == [0, 1, 2, 3, 3, 4, 4]
    assert {name.rsplit("-", 1)[0] for name in folders(spark) - before} == {"cost-out"}
