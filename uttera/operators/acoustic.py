"""Signal measures of clips and the acoustic gate, by array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOUD, CLIPPED = 0.02, 0.999


def _mean_square(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")) / F.size(x)


def measures(df: DataFrame, samples_col: str, rate_col: str | int, text_col: str | None = None, frame: int | None = None, loud: float = LOUD) -> DataFrame:
    """``df`` with dur, rms, clip, activity and, with a text, sec_per_char.

    A frame is 25 ms, or ``frame`` samples; what is left at the end is no
    frame; a clip without a whole frame has null activity, an empty one null measures.
    """
    x = F.col(samples_col)
    n = F.size(x)
    rate = F.lit(rate_col) if isinstance(rate_col, int) else F.col(rate_col)
    fr = F.lit(frame) if frame else F.greatest(F.lit(1), F.floor(rate * 0.025).cast("int"))
    m = F.floor(n / fr).cast("int")
    frames = F.when(m > 0, F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.sqrt(_mean_square(F.slice(x, i * fr + 1, fr)) + 1e-12)))
    has = n > 0
    out = df.withColumns({
        "dur": (n / rate).cast("double"),
        "rms": F.when(has, F.sqrt(_mean_square(x) + 1e-12)),
        "clip": F.when(has, F.size(F.filter(x, lambda v: F.abs(v) > CLIPPED)) / n),
        "activity": F.when(has, F.size(F.filter(frames, lambda v: v > loud)) / m),
    })
    return out if text_col is None else out.withColumn("sec_per_char", F.col("dur") / F.greatest(F.lit(1), F.length(text_col)))


def gate(dur: tuple[float, float] = (0.4, 30.0), rms: float = 0.01, clip: float = 0.05, activity: float = 0.10, pace: tuple[float, float] = (0.04, 0.40)) -> Column:
    """Whether measures are those of a sound clip; a missing one or a NaN is a no."""
    cols = ("dur", "rms", "clip", "activity", "sec_per_char")
    ok = F.col("dur").between(*dur) & (F.col("rms") >= rms) & (F.col("clip") < clip) & (F.col("activity") >= activity) & F.col("sec_per_char").between(*pace)
    for c in cols:
        ok = ok & ~F.isnan(c)
    return F.coalesce(ok, F.lit(False))
