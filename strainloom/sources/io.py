"""Readers and writers: delimited text, Parquet, JSON and NPZ, integrity checks, gzip by suffix, checkpoints."""

from __future__ import annotations

import io
import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def preferred_path(path: str) -> str:
    """The .gz sibling of a local path where there is one."""
    return path + ".gz" if os.path.exists(path + ".gz") else path


def read_delimited(spark: SparkSession, path: str, schema: StructType | str | None = None, sep: str | None = None, multi_line: bool = False) -> DataFrame:
    """A CSV or TSV file (also gzipped) with a header; tab by suffix. Without a schema all columns are strings.

    Line breaks inside quotes need multi_line, with which a file is one task; without it files are split.
    """
    path = preferred_path(path)
    sep = sep or ("\t" if path.removesuffix(".gz").endswith((".tsv", ".txt")) else ",")
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", multi_line)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document a file."""
    return spark.read.option("multiLine", True).json(path)


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """(name, pos, code) of the integer vectors in NPZ files; each file is read in one task."""
    import numpy as np

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch.content:
                with np.load(io.BytesIO(content)) as z:
                    for name in z.files:
                        yield pd.DataFrame({"name": name, "pos": range(len(z[name])), "code": z[name].astype("int64")})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "name string, pos long, code long")


def checksums(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, sha256) of the files."""
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256"))


def verify_checksums(spark: SparkSession, expected: dict[str, str]) -> None:
    """Raise ValueError naming the files whose sha256 differs."""
    found = {r.path.removeprefix("file:").replace("///", "/"): r.sha256 for r in checksums(spark, list(expected)).collect()}  # a row a file named by the caller
    wrong = sorted(p for p, h in expected.items() if found.get(p) != h)
    if wrong:
        raise ValueError(f"changed inputs: {wrong}")


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold nulls only (one aggregate over all columns)."""
    if not df.columns:
        return df
    held = df.agg(*[F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return df.select([F.col(f"`{c}`") for i, c in enumerate(df.columns) if held[i]])


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    """A folder of CSV or TSV parts with headers; gzip when the path ends in .gz. Arrays are written as JSON."""
    flat = df.select([F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
    flat.write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"').option("compression", "gzip" if path.endswith(".gz") else "none").csv(path)


def write_summary(path: str, **values) -> None:
    """A small JSON summary of a run, written whole and then renamed."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".part", "w") as f:
        json.dump(values, f, indent=1, sort_keys=True)
    os.replace(path + ".part", path)


def resume_replicates(spark: SparkSession, path: str, fingerprint: str, replicates: int, compute: Callable[[DataFrame], DataFrame], batch: int | None = None) -> DataFrame:
    """The results of replicates 0..n-1, computing only those not yet in the table at `path`.

    compute takes (replicate) and returns rows with a replicate column; results are appended as Parquet partitioned
    by fingerprint, so runs with other settings never mix and a second run computes nothing. With `batch`, that many
    replicates are computed and committed at a time: a batch that fails leaves no rows, is noted beside the results
    (see failed_replicates) and tried again by the next run, while the others go on.
    """
    wanted = spark.range(replicates).select(F.col("id").cast("int").alias("replicate"))
    here, notes = f"{path}/fingerprint={fingerprint}", f"{path}/failures/fingerprint={fingerprint}"
    done = _read_if_there(spark, here)
    todo = wanted if done is None else wanted.join(done.select("replicate").distinct(), "replicate", "left_anti")
    size = batch or replicates
    for first in range(0, replicates, size):
        part = todo.where((F.col("replicate") >= first) & (F.col("replicate") < first + size))
        if part.isEmpty():
            continue
        try:
            compute(part).write.mode("append").parquet(here)
        except Exception as e:
            if batch is None:
                raise
            part.select("replicate", F.lit(str(e)[:2000]).alias("error")).write.mode("append").parquet(notes)
    got = _read_if_there(spark, here)
    if got is None:
        raise RuntimeError("no replicate was computed")
    return got.join(F.broadcast(wanted), "replicate", "left_semi")


def failed_replicates(spark: SparkSession, path: str, fingerprint: str) -> DataFrame | None:
    """(replicate, error) of the batches that failed in some run, None if there are none."""
    return _read_if_there(spark, f"{path}/failures/fingerprint={fingerprint}")


def _read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
