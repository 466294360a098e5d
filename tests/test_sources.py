"""Readers, writers, checkpoints of replicates, and the streaming counts."""

import gzip
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from strainloom.__main__ import main
from strainloom.sources import io as S
from strainloom.streaming.counts import windowed_counts


def test_delimited_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', [0.5, 1.0]), (2, None, [])], "id int, t string, v array<double>")
    S.write_delimited(df, str(tmp_path / "out.tsv.gz"), "\t")
    got = S.read_delimited(spark, str(tmp_path / "out.tsv.gz"), sep="\t").orderBy("id").collect()
    assert [r.t for r in got] == ['a "b", c', None] and json.loads(got[0].v) == [0.5, 1.0]
    with gzip.open(tmp_path / "x.csv.gz", "wt") as f:
        f.write("id,empty\n7,\n")
    wide = S.read_delimited(spark, str(tmp_path / "x.csv"), "id int, empty string")
    assert S.drop_all_null_columns(wide).columns == ["id"] and wide.first().id == 7


def test_npz_json_and_checksums(spark, tmp_path):
    np.savez(tmp_path / "v.npz", v0=np.array([3, 1]), v1=np.array([2]))
    assert sorted(map(tuple, S.read_npz(spark, str(tmp_path / "v.npz")).collect())) == [("v0", 0, 3), ("v0", 1, 1), ("v1", 0, 2)]
    S.write_summary(str(tmp_path / "s.json"), rows=3)
    assert S.read_json(spark, str(tmp_path / "s.json")).first().rows == 3
    path = str(tmp_path / "s.json")
    found = S.checksums(spark, [path]).first().sha256
    S.verify_checksums(spark, {path: found})
    with pytest.raises(ValueError):
        S.verify_checksums(spark, {path: "0"})


def test_replicates_resume(spark, tmp_path):
    seen = []

    def compute(wanted):
        seen.append(wanted.count())
        return wanted.withColumn("x", F.col("replicate") * 2)

    for n in (3, 5, 5):
        assert S.resume_replicates(spark, str(tmp_path / "r"), "f1", n, compute).count() == n
    assert seen == [3, 2]


def test_streaming_counts_equal_batch(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id) as ts, if(id % 9 = 0, null, concat('n', id % 3)) as node, id % 4 as cluster from range(100)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = windowed_counts(stream, "ts", "node", "cluster").writeStream.outputMode("complete").format("memory").queryName("counts_now").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("counts_now").collect())) == sorted(map(tuple, windowed_counts(rows, "ts", "node", "cluster").collect()))


def test_a_failed_batch_is_noted_and_tried_again(spark, tmp_path):
    broken = [True]

    def compute(wanted):
        if broken[0] and wanted.where("replicate = 2").count():
            raise ValueError("no luck")
        return wanted.withColumn("x", F.col("replicate") * 2)

    path = str(tmp_path / "r")
    assert sorted(r.replicate for r in S.resume_replicates(spark, path, "f1", 5, compute, batch=2).collect()) == [0, 1, 4]
    assert [(r.replicate, r.error) for r in S.failed_replicates(spark, path, "f1").orderBy("replicate").collect()] == [(2, "no luck"), (3, "no luck")]
    broken[0] = False
    assert S.resume_replicates(spark, path, "f1", 5, compute, batch=2).count() == 5
    assert S.failed_replicates(spark, path, "f2") is None


def test_command_line(spark, tmp_path, capsys):
    assert main(["--list"]) == 0 and "node_richness" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["/root/testdata/sf0.001", "no_such_query"])
    if os.path.isdir("/root/testdata/sf0.001"):
        assert main(["/root/testdata/sf0.001", "rarefaction_cutoff", "--out", str(tmp_path / "o")]) == 0
        assert S.read_json(spark, str(tmp_path / "o/summary.json")).count() == 1
