"""Model calls as pluggable functions over batches, with retries and a deterministic stub."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ModelFn = Callable[[list[str]], list[str | None]]


def with_retries(fn: ModelFn, attempts: int = 5, base: float = 2.0, longest: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> ModelFn:
    """``fn`` tried again after pauses that double; None for each prompt when all fail."""

    def run(prompts: list[str]) -> list[str | None]:
        for k in range(attempts):
            try:
                return list(fn(prompts))
            except Exception:
                if k + 1 < attempts:
                    sleep(min(base * 2**k, longest))
        return [None] * len(prompts)

    return run


def respond(df: DataFrame, prompt_col: str, fn: ModelFn, out_col: str = "response", batch: int = 16) -> DataFrame:
    """``df`` with the model's response to each prompt; a null prompt has a null response."""
    schema = df.withColumn(out_col, F.lit(None).cast("string")).schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got: list[str | None] = [None] * len(p)
            ask = [i for i, x in enumerate(p[prompt_col]) if x is not None]
            for k in range(0, len(ask), batch):
                some = ask[k : k + batch]
                for i, r in zip(some, fn([p[prompt_col].iloc[i] for i in some]), strict=True):
                    got[i] = r
            p[out_col] = pd.Series(got, index=p.index, dtype=object)
            yield p

    return df.mapInPandas(run, schema)


def stub(choices: list[str]) -> ModelFn:
    """A model that names one of the choices by the prompt's hash; offline and the same everywhere."""

    def run(prompts: list[str]) -> list[str | None]:
        return [json.dumps({"intent": choices[int(hashlib.sha1(p.encode()).hexdigest(), 16) % len(choices)]}) for p in prompts]

    return run


def scored_transcripts(df: DataFrame, hear: Callable[[str], str], score: Callable[[DataFrame], DataFrame], wav_col: str = "wav", attempts: int = 4, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``df`` with hyp, error and what ``score`` adds: a sound that fails every time has a null hyp, no score and the error's first 200 characters."""
    schema = df.withColumn("hyp", F.lit(None).cast("string")).withColumn("error", F.lit(None).cast("string")).schema

    def one(path: str) -> tuple[str | None, str | None]:
        why = None
        for k in range(attempts):
            try:
                return hear(path), None
            except Exception as e:
                why = str(e)[:200]
                if k + 1 < attempts:
                    sleep(min(2.0**k * 2, 30.0))
        return None, why

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = [one(x) for x in p[wav_col]]
            p["hyp"], p["error"] = pd.Series([h for h, _ in got], index=p.index, dtype=object), pd.Series([e for _, e in got], index=p.index, dtype=object)
            yield p

    return score(df.mapInPandas(run, schema))


SpeakFn = Callable[[str, str, int], "tuple[list[float], int]"]


def spoken(items: DataFrame, speak: SpeakFn, rate: int = 16_000, attempts: int = 3, least_rms: float = 0.01, least_s: float = 0.4) -> DataFrame:
    """(id, samples, ref_id, attempts, error) of items (id, text, ref_id, retry_ref_id).

    ``speak`` (text, reference, attempt) gives samples and their rate.  A sound
    is accepted that is loud and long enough; others are tried again, the last
    time with the other reference.  What fails has null samples and an error.
    """
    from uttera.sources.readers import resampled

    def one(text: str, ref: str, other: str):
        used, why = ref, "silent or short"
        for k in range(attempts):
            used = other if k and k + 1 == attempts else ref
            try:
                x, r = speak(text, used, k)
            except Exception as e:
                return None, used, k + 1, str(e)[:120]
            x = resampled(np.asarray(x, np.float32), r, rate)
            if len(x) >= least_s * rate and float(np.sqrt((x**2).mean() + 1e-12)) >= least_rms:
                return x, used, k + 1, None
        return None, used, attempts, why

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = [one(t, a, b) for t, a, b in zip(p["text"], p["ref_id"], p["retry_ref_id"], strict=True)]
            yield pd.DataFrame({"id": p["id"].to_numpy(), **{c: pd.Series([g[j] for g in got], dtype=object) for j, c in enumerate(("samples", "ref_id", "attempts", "error"))}})

    return items.select("id", "text", "ref_id", "retry_ref_id").mapInPandas(run, "id string, samples array<float>, ref_id string, attempts int, error string")
