"""Writers of the pipeline's file formats."""

from __future__ import annotations

import io
import json
import struct
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttera.operators.submission import by_number
from uttera.schemas import MANIFEST

#: Columns of a manifest in their order.
FIELDS = [f.name for f in MANIFEST.fields]


def jsonl(df: DataFrame, path: str, append: bool = False, nulls: bool = False) -> None:
    """JSON lines; with ``nulls`` null fields are written."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", str(not nulls).lower()).json(path)


def append_new(df: DataFrame, done: DataFrame | None, id_col: str, path: str) -> None:
    """Appends the rows whose id isn't among the finished ones."""
    new = df if done is None else df.join(done.select(id_col).distinct(), id_col, "left_anti")
    jsonl(new, path, append=True)


def csv_manifest(df: DataFrame, path: str) -> None:
    """A manifest with doubled quotes; white space at the ends of cells stays."""
    df.select(*FIELDS).write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=False, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def label_list(df: DataFrame, path: str, col: str = "label") -> None:
    """A sorted list, one file; an inventory is small."""
    df.select(F.col(col).cast("string").alias("value")).orderBy("value").coalesce(1).write.mode("overwrite").text(path)


def tsv_pool(df: DataFrame, path: str) -> None:
    """(wav, gold) in the order of pos, one file; a pool is small."""
    df.orderBy("pos").select(F.concat_ws("\t", "wav", "gold").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def metrics(df: DataFrame, path: str, digits: int = 4) -> dict:
    """The one row of ``df`` as a JSON file, rounded; without a score, a note instead."""
    row = df.first()
    m = {k: round(v, digits) if isinstance(v, float) else v for k, v in (row.asDict() if row else {}).items()}
    if m.get("accuracy", 0) is None or not row:
        m = {k: v for k, v in m.items() if v is not None} | {"note": "no gold labels, predictions only"}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(m, f, indent=2, ensure_ascii=False)
    return m


def submission(df: DataFrame, path: str, id_col: str = "id", name: str = "predictions.jsonl") -> int:
    """A zip with one file of rows in the order of their ids' numbers, streamed partition by partition."""
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z, z.open(name, "w") as raw, io.TextIOWrapper(raw, "utf-8") as out:
        for r in by_number(df, id_col).toLocalIterator():
            out.write(json.dumps(r.asDict(recursive=True), ensure_ascii=False) + "\n")
            n += 1
    return n


def wav_bytes(samples, rate: int) -> bytes:
    """A 16-bit sound file of samples from -1 to 1."""
    data = b"".join(struct.pack("<h", max(-32768, min(32767, round(float(x) * 32768)))) for x in samples)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def wav_files(df: DataFrame, folder: str, rate: int, name_col: str = "name", samples_col: str = "samples") -> None:
    """A sound file for each row, written by the tasks; ``folder`` is one that all executors share."""

    def run(rows):
        import os

        for r in rows:
            tmp = os.path.join(folder, f".{r[0]}.tmp")
            with open(tmp, "wb") as f:
                f.write(wav_bytes(r[1], rate))
            os.replace(tmp, os.path.join(folder, f"{r[0]}.wav"))  # a task that is run again leaves the same file

    df.select(name_col, samples_col).foreachPartition(run)
