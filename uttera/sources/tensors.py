"""Sharded tensor files as (key, row, col, val) tables and back.

The format: eight bytes with the header's length, a JSON header of each
tensor's type, shape and place, then the data.  Shards lie in storage that all
executors see; each task reads only the bytes of its tensors.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

ENTRIES = "key string, row long, col long, val double"
TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2"}
AT_ONCE = 1 << 20


def header(path: str) -> tuple[dict, int]:
    """The tensors of a shard, and where its data begins."""
    with open(path, "rb") as f:
        n = int.from_bytes(f.read(8), "little")
        return {k: v for k, v in json.loads(f.read(n)).items() if k != "__metadata__"}, 8 + n


def entries(path: str, key: str) -> Iterator[pd.DataFrame]:
    """The entries of a tensor in parts; one of one dimension is a row."""
    h, base = header(path)
    shape = ([1, *h[key]["shape"]] if len(h[key]["shape"]) < 2 else h[key]["shape"]) or [1, 1]
    cols, start, kind = int(np.prod(shape[1:])), base + h[key]["data_offsets"][0], h[key]["dtype"]
    width = 2 if kind == "BF16" else np.dtype(TYPES[kind]).itemsize
    with open(path, "rb") as f:
        f.seek(start)
        for at in range(0, shape[0] * cols, AT_ONCE):
            n = min(AT_ONCE, shape[0] * cols - at)
            raw = f.read(n * width)
            x = (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32) if kind == "BF16" else np.frombuffer(raw, TYPES[kind])
            i = np.arange(at, at + n)
            yield pd.DataFrame({"key": key, "row": i // cols, "col": i % cols, "val": x.astype(float)})


def read_tensors(spark: SparkSession, folder: str, index: str = "model.safetensors.index.json") -> DataFrame:
    """(key, row, col, val) of all tensors that the index names, one task or more a shard."""
    with open(os.path.join(folder, index), encoding="utf-8") as f:
        where = json.load(f)["weight_map"]
    keys = spark.createDataFrame(sorted((os.path.join(folder, v), k) for k, v in where.items()), "path string, key string")

    def run(parts):
        for p in parts:
            for path, key in zip(p["path"], p["key"], strict=True):
                yield from entries(path, key)

    return keys.repartition(max(1, len(set(where.values()))), "path").mapInPandas(run, ENTRIES)


def write_tensors(df: DataFrame, folder: str, shards: int, index: str = "model.safetensors.index.json") -> dict[str, str]:
    """Writes ``df`` as 32-bit shards and their index, whose map is returned; a shard must fit a task's memory."""
    os.makedirs(folder, exist_ok=True)
    keys = sorted(r[0] for r in df.select("key").distinct().limit(1_000_001).collect())
    if len(keys) > 1_000_000:
        raise ValueError("more than a million tensors")
    name = lambda i: f"model-{i + 1:05d}-of-{shards:05d}.safetensors"
    where = {k: name(i % shards) for i, k in enumerate(keys)}
    of = df.sparkSession.createDataFrame(sorted(where.items()), "key string, shard string")

    def shard(p: pd.DataFrame) -> pd.DataFrame:
        head, data, at = {}, [], 0
        for k, g in p.groupby("key", sort=True):
            x = np.zeros((int(g["row"].max()) + 1, int(g["col"].max()) + 1), "<f4")
            x[g["row"].to_numpy(), g["col"].to_numpy()] = g["val"]
            head[k] = {"dtype": "F32", "shape": list(x.shape), "data_offsets": [at, at + x.nbytes]}
            data.append(x.tobytes())
            at += x.nbytes
        text = json.dumps(head).encode()
        path = os.path.join(folder, p["shard"].iloc[0])
        with open(path + ".tmp", "wb") as f:
            f.write(len(text).to_bytes(8, "little") + text + b"".join(data))
        os.replace(path + ".tmp", path)  # a task that is run again leaves the same file
        return pd.DataFrame({"shard": [p["shard"].iloc[0]]})

    df.join(of, "key").groupBy("shard").applyInPandas(shard, "shard string").count()
    with open(os.path.join(folder, index), "w", encoding="utf-8") as f:
        json.dump({"weight_map": where}, f)
    return where
