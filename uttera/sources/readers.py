"""Readers of the pipeline's file formats, with explicit schemas."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uttera.schemas import MANIFEST, conform


def csv_manifest(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A manifest with doubled quotes and line breaks in cells; absent columns are null, durations that are no number too."""
    raw = spark.read.csv(paths, header=True, multiLine=True, escape='"')
    return conform(raw, MANIFEST)


def csv_splits(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All of the files that exist; an empty manifest where none does."""
    there = [p for p in paths if _exists(spark, p)]
    return csv_manifest(spark, there) if there else spark.createDataFrame([], MANIFEST)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped; a broken one fails, or is null if not strict."""
    return spark.read.schema(schema).json(paths, mode="FAILFAST" if strict else "PERMISSIVE")


def json_document(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """One JSON document a file, with its path."""
    return spark.read.schema(schema).json(paths, multiLine=True).withColumn("path", F.input_file_name())


def runs(spark: SparkSession, glob: str, schema: T.StructType, pattern: str = r"([^/]+)\.jsonl?$") -> DataFrame:
    """All files of a glob in one table, with run, the part of the file's name that the pattern captures."""
    return spark.read.schema(schema).json(glob).withColumn("run", F.regexp_extract(F.input_file_name(), pattern, 1))


def label_list(spark: SparkSession, path: str, comments: bool = True) -> DataFrame:
    """(label) of a list, one a line, stripped, without blank lines and, with ``comments``, those that begin with #; distinct, sorted."""
    t = spark.read.text(path).select(F.trim("value").alias("label")).where("label <> ''")
    if comments:
        t = t.where(~F.startswith("label", F.lit("#")))
    return t.distinct().orderBy("label")


def ordered_labels(spark: SparkSession, path: str) -> DataFrame:
    """(pos, label) in the list's order; a list is one small file."""
    t = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "label"))
    return t.select("pos", F.trim("label").alias("label")).where("label <> ''")


def tsv_pool(spark: SparkSession, path: str) -> DataFrame:
    """(pos, wav, text) of lines with at most one split; pos from 0 in the file's order."""
    t = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line")).where("line <> ''")
    p = F.split("line", "\t", 2)
    return t.select("pos", F.get(p, F.lit(0)).alias("wav"), F.get(p, F.lit(1)).alias("text"))


def id_set(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(id): the different words of text files."""
    return spark.read.text(paths).select(F.explode(F.split("value", r"(?U)\s+")).alias("id")).where("id <> ''").distinct()


def listing(spark: SparkSession, glob: str) -> DataFrame:
    """(path, length) of files, without reading them."""
    return spark.read.format("binaryFile").load(glob).select("path", "length")


def wav_headers(spark: SparkSession, glob: str) -> DataFrame:
    """(path, rate, duration) of sound files by the 44 bytes of their headers, which is all that is read; no RIFF file has duration 0; rounded to 3 places."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            heads = []
            for path in part.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(at) as f:
                    heads.append(f.read(44))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(heads, pa.binary())], ["path", "length", "head"])

    f = listing(spark, glob).mapInArrow(run, "path string, length long, head binary")
    number = lambda at: F.conv(F.concat(*[F.lpad(F.hex(F.substring("head", at + i, 1)), 2, "0") for i in (3, 2, 1, 0)]), 16, 10).cast("long")
    riff = (F.length("head") >= 44) & (F.hex(F.substring("head", 1, 4)) == "52494646")
    rate, per_s = F.when(riff, number(25)), F.when(riff, number(29))
    per_s = F.when(per_s == 0, rate * 2).otherwise(per_s)
    d = F.coalesce((F.col("length") - 44) / F.nullif(per_s, F.lit(0)), F.lit(0.0))
    return f.select("path", rate.alias("rate"), F.round(F.greatest(d, F.lit(0.0)), 3).alias("duration"))


def resampled(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Samples at another rate: a windowed sinc, its band that of the lower rate, so that nothing folds back."""
    if rate == to or not len(x):
        return x
    n, cut, reach = max(1, round(len(x) * to / rate)), min(1.0, to / rate), 16
    out = np.empty(n, np.float32)
    width = int(np.ceil(reach / cut))
    padded = np.pad(x, width)
    for k in range(0, n, 65_536):
        t = np.arange(k, min(n, k + 65_536)) * (rate / to)
        at = np.floor(t).astype(np.int64)
        off = np.arange(-width + 1, width + 1)
        d = t[:, None] - (at[:, None] + off)
        w = cut * np.sinc(cut * d) * np.cos(np.pi / 2 * np.clip(d / width, -1, 1)) ** 2
        out[k : k + len(t)] = (padded[at[:, None] + off + width] * w).sum(1)
    return out


def pcm(c: Column, rate: int | None = None) -> Column:
    """Samples of 16-bit sound files, from -1 to 1, channels averaged, at ``rate`` if one is given; null for what is none."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import io
        import wave

        def one(b: bytes | None) -> np.ndarray | None:
            try:
                with wave.open(io.BytesIO(b)) as w:
                    x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype("float32") / 32768
                    if w.getsampwidth() != 2:
                        return None
                    x = x.reshape(-1, w.getnchannels()).mean(1)
                    return x if rate is None else resampled(x, w.getframerate(), rate)
            except Exception:
                return None

        for s in parts:
            yield s.map(one)

    return run(c)


def env_value(path: str, key: str) -> str | None:
    """The value of KEY=VALUE in a settings file, without quotes."""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                k, eq, v = line.partition("=")
                if eq and k.strip().removeprefix("export ").strip() == key:
                    return v.strip().strip("'\"")
    return os.environ.get(key)
