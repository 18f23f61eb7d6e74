"""Reading model responses: JSON inside prose, intents, fuzzy labels."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.functions.text import gold, strip

CUTOFF = 0.85


def extract_json(c: Column) -> Column:
    """The JSON of a response as a variant: without its code fence, else its outermost array, else its outermost object; null if none parses."""
    s = strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))
    tries = [s, F.nullif(F.regexp_extract(s, r"(?s)(\[.*\])", 1), F.lit("")), F.nullif(F.regexp_extract(s, r"(?s)(\{.*\})", 1), F.lit(""))]
    return F.coalesce(*[F.try_parse_json(x) for x in tries])


def named_intent(c: Column) -> Column:
    """What stands after ``"intent":`` in a response, stripped; null without it."""
    return gold(F.regexp_extract(c, r'"intent"\s*:\s*"([^"]+)"', 1))


def strict_intent(c: Column) -> Column:
    """The intent of a response that is a JSON object, if it's a string; of one that isn't JSON, what stands after ``"intent":``."""
    s = strip(F.coalesce(c, F.lit("")))
    v = F.try_parse_json(s)
    is_text = F.schema_of_variant(F.try_variant_get(v, "$.intent", "variant")) == "STRING"
    return F.when(v.isNotNull(), F.when(is_text, strip(F.try_variant_get(v, "$.intent", "string")))).otherwise(named_intent(s))


def first_word_label(c: Column, labels: list[str]) -> Column:
    """The first of the sorted labels that occurs in the text as a whole word, whatever its case."""
    out = F.lit(None).cast("string")
    for x in reversed(sorted(set(labels))):
        out = F.when(F.regexp_like(c, F.lit(rf"(?iU)\b\Q{x}\E\b")), F.lit(x)).otherwise(out)
    return out


def nearest(values: DataFrame, value_col: str, labels: list[str], cutoff: float = CUTOFF) -> DataFrame:
    """(value, label): for each distinct value the label of greatest Ratcliff-Obershelp ratio in lower case, if it reaches the cutoff."""
    lower = {x.lower(): x for x in sorted(set(labels))}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = [(v, difflib.get_close_matches(v.lower(), list(lower), n=1, cutoff=cutoff)) for v in p["value"]]
            yield pd.DataFrame([(v, lower[m[0]]) for v, m in got if m], columns=["value", "label"])

    return values.select(F.col(value_col).alias("value")).where("value is not null").distinct().mapInPandas(run, "value string, label string")


def predicted_intent(df: DataFrame, response_col: str, labels: list[str], out_col: str = "pred", cutoff: float | None = CUTOFF) -> DataFrame:
    """``df`` with the intent its response names.

    The name after ``"intent":`` as the label it equals but for case, else the
    nearest label, else itself; a response without it, the first label in it as
    a whole word; else null.  Only the different names that equal no label are
    compared with the labels, which must be a bounded list; with ``cutoff``
    None none are.
    """
    lower = F.create_map(*[F.lit(x) for label in sorted(set(labels)) for x in (label.lower(), label)])
    with_name = df.withColumn("_name", named_intent(F.col(response_col)))
    exact = F.try_element_at(lower, F.lower("_name"))
    if cutoff is None:
        joined = with_name.withColumn("_near", F.lit(None).cast("string"))
    else:
        off = with_name.where(F.col("_name").isNotNull() & exact.isNull())
        joined = with_name.join(nearest(off, "_name", labels, cutoff).toDF("_name", "_near"), "_name", "left")
    pred = F.when(F.col("_name").isNotNull(), F.coalesce(exact, F.col("_near"), F.col("_name"))).otherwise(first_word_label(F.col(response_col), labels))
    return joined.withColumn(out_col, pred).drop("_name", "_near")
