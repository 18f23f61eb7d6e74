"""The best checkpoints of training logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def log_rows(logs: DataFrame) -> DataFrame:
    """(run, pos, step, eval_loss) of (run, log_history): the entries with a loss, in order."""
    return logs.select("run", F.posexplode("log_history").alias("pos", "e")).select("run", "pos", "e.step", "e.eval_loss").where("eval_loss is not null")


def best_steps(rows: DataFrame, surviving: DataFrame | None = None) -> DataFrame:
    """(run, step, eval_loss) of least loss, the first of equals; with ``surviving`` (run, step) among those only."""
    r = rows if surviving is None else rows.join(surviving.select("run", "step").distinct(), ["run", "step"], "left_semi")
    return r.where("eval_loss is not null").groupBy("run").agg(F.min_by(F.struct("step", "eval_loss"), F.struct("eval_loss", "pos")).alias("b")).select("run", "b.step", "b.eval_loss")


def checkpoint_number(col: str):
    """The number of ``checkpoint-123`` in a path; null without one."""
    return F.nullif(F.regexp_extract(col, r"checkpoint-(\d+)", 1), F.lit("")).try_cast("bigint")
