"""The pipeline, stage by stage, on its own input against plain Python."""
from collections import Counter

import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from riskgraph.llm import quality
from riskgraph.sources.io import cut

from .test_decontaminate import held
from .test_jaccard import brute as jaccard_classes
from .test_mixing import brute as mixture
from .test_sharding import check as check_shards

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    z = zstandard.ZstdCompressor(level=quality.LEVEL)
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = cut(stage(spark, docs, SF), "test-pipeline")
        after = docs.collect()
        if name != "sharding":
            assert docs.columns == columns
        rows = [tuple(r) for r in after]
        if name == "quality_rules":
            assert Counter(rows) == Counter(r for r in before if quality.judge(r[1].encode(), z)[6])
        elif name == "near_duplicates":
            classes = jaccard_classes([r[:2] for r in before])
            assert sorted(r[0] for r in rows) == sorted({c for _, c in classes.values()})
            assert set(rows) <= set(before)
        elif name == "benchmark_decontamination":
            bad = {i for i, _ in held([r[:2] for r in before], bench)}
            gone = set(before) - set(rows)
            assert bad <= {r[0] for r in gone} and len(gone) <= len(bad) + 2
        elif name == "source_mixing":
            copies = Counter(r[0] for r in rows)
            want = mixture([(r[0], r[1], r[3]) for r in before])
            assert all(copies[i] * size == taken for i, size, _, _, taken in want)
        else:
            check_shards(after, [r[:2] for r in before])


def test_run_is_the_stages_and_odd_rows_pass(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = rows.limit(3).withColumn("text", F.lit(None).cast("string")).union(rows.limit(2).withColumn("source", F.lit(None).cast("string"))) \
        .union(rows.limit(2)).union(rows.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    rows.union(odd).withColumn("shard", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() > 0 and "shard" in got.columns
    rows.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
