"""Consensus from several annotators' labels (problem 3).

Confidence-aware truth discovery: items' consensus and annotators' weights are
found in turn.  An annotator's distance is that of the answers to the weighted
consensus of the *others* on the same items, so that nobody confirms himself;
its weight is the inverse of the chi-squared upper bound on the variance of
that distance, which takes weight from annotators with few answers.  Where
that bound isn't below the distance that answers drawn at random with the same
frequencies would have, the answers go with the others' no better than by
chance, or against them, and the weight is 0.

Verdicts are shuffled once: an item's are one row of a table, which holds an
annotator at most once and so is no longer than the list of annotators.  A round
is one pass over that table without a shuffle, in Arrow batches, which returns
sums by annotator; their list and weights go into the tasks.  With more than
MOST annotators, items' and annotators' sums meet in joins instead, partially
aggregated before each shuffle (:func:`discover_joined`), with the same results.
Rounds go on until no share of weight moves by TOLERANCE.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.session import stage

FIELDS = ("derja", "natural", "intent_match", "slots_ok")
#: The answers of a field in order; booleans count as 0 and 1.
LEVELS = {"derja": (1, 2, 3, 4, 5), "natural": (1, 2, 3, 4, 5)}
#: Below this the consensus of a field is a case.
LIMIT = {"derja": 3.0, "natural": 3.0, "intent_match": 0.5, "slots_ok": 0.5}
ALPHA_Z = 1.959964
#: Share by which the bound must lie below chance.
MARGIN = 0.03
#: Rounds after which an iteration that does not settle ends; :func:`reliability` tells how many there were and the last movement.
ROUNDS = 100
TOLERANCE = 1e-3
#: Annotators whose weights go into the tasks.
MOST = 20_000
SUMS = ("n", "d", "x", "xx", "o", "oo")


def chi_squared(n: Column, z: float) -> Column:
    """Quantile of the chi-squared distribution with n degrees of freedom at the normal quantile z (Wilson and Hilferty)."""
    a = 2.0 / (9.0 * n)
    return n * F.pow(F.greatest(1.0 - a + z * F.sqrt(a), F.lit(1e-3)), 3)


def verdicts(judged: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(item_id, annotator, a0, a1, ...): one row an item and annotator, answers as numbers, null where none was given.

    Verdicts written twice are one; if their answers differ, the latest seq that has one counts.
    """
    src = judged.where("item_id is not null and annotator is not null")
    return src.groupBy("item_id", "annotator").agg(*[F.max_by(F.col(f).cast("double"), F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f"a{i}") for i, f in enumerate(fields)])


def _sums(v: DataFrame, w: DataFrame, k: int) -> DataFrame:
    """Weighted sums by item: s (weight x answer) and w (weight) of each field."""
    j = v.join(w, "annotator")
    aggs = []
    for i in range(k):
        has = F.col(f"a{i}").isNotNull()
        aggs += [F.sum(F.col(f"w{i}") * F.col(f"a{i}")).alias(f"s{i}"), F.sum(F.when(has, F.col(f"w{i}"))).alias(f"t{i}")]
    return j.groupBy("item_id").agg(*aggs)


def _weights(v: DataFrame, w: DataFrame, k: int) -> DataFrame:
    """New weights from the distances to the others' consensus."""
    j = v.join(w, "annotator").join(_sums(v, w, k), "item_id")
    aggs = []
    for i in range(k):
        a, t = F.col(f"a{i}"), F.col(f"t{i}") - F.col(f"w{i}")
        o = F.when(a.isNotNull() & (t > 1e-9 * F.col(f"t{i}")), (F.col(f"s{i}") - F.col(f"w{i}") * a) / t)
        x = F.when(o.isNotNull(), a)
        aggs += [F.count(x).alias(f"n{i}"), F.sum((x - o) * (x - o)).alias(f"d{i}"), F.sum(x).alias(f"x{i}"), F.sum(x * x).alias(f"xx{i}"), F.sum(o).alias(f"o{i}"), F.sum(o * o).alias(f"oo{i}")]
    g = j.groupBy("annotator").agg(*aggs)
    out = ["annotator"]
    for i in range(k):
        n = F.greatest(F.col(f"n{i}"), F.lit(1)).cast("double")
        mx, mo = F.col(f"x{i}") / n, F.col(f"o{i}") / n
        chance = (F.col(f"xx{i}") / n - mx * mx) + (F.col(f"oo{i}") / n - mo * mo) + (mx - mo) * (mx - mo)
        bound = (F.col(f"d{i}") + 0.01) / chi_squared(n, -ALPHA_Z)
        weight = F.when((F.col(f"n{i}") > 0) & (bound * (1 + MARGIN) < chance), 1.0 / F.greatest(bound, F.lit(1e-6))).otherwise(0.0)
        out += [F.coalesce(weight, F.lit(0.0)).alias(f"w{i}"), F.col(f"n{i}").alias(f"m{i}"), (F.col(f"d{i}") / n).alias(f"e{i}"), chance.alias(f"c{i}")]
    return g.select(*out)


def discover_joined(judged: DataFrame, fields: tuple[str, ...] = FIELDS, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, int, float]:
    """(verdicts, weights, rounds, last movement), by joins."""
    k = len(fields)
    v = stage(verdicts(judged, fields))
    w = v.select("annotator").distinct().select("annotator", *[F.lit(1.0).alias(f"w{i}") for i in range(k)])
    far = float("inf")
    for n in range(rounds):
        new = stage(_weights(v, w, k))
        if n:
            moved = new.select("annotator", *[F.col(f"w{i}").alias(f"v{i}") for i in range(k)]).join(w, "annotator")
            tot = moved.agg(*[x for i in range(k) for x in (F.sum(F.abs(F.col(f"v{i}") - F.col(f"w{i}"))), F.sum(f"v{i}"))]).first()
            far = max((tot[2 * i] or 0) / (tot[2 * i + 1] or 1) for i in range(k))
        w = new
        if far <= TOLERANCE:
            break
    return v, w, n + 1, far


def packed(judged: DataFrame, fields: tuple[str, ...], names: list[str]) -> DataFrame:
    """(item_id, v): an item's verdicts, an array of (number of the annotator in ``names``, a0, a1, ...)."""
    code = judged.sparkSession.createDataFrame([(x, i) for i, x in enumerate(names)], "annotator string, code int")
    v = verdicts(judged, fields).join(F.broadcast(code), "annotator")  # at most MOST rows
    return stage(v.groupBy("item_id").agg(F.collect_list(F.struct("code", *[F.col(f"a{i}").cast("float").alias(f"a{i}") for i in range(len(fields))])).alias("v")))


def _flat(part: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of a batch of items: each verdict's row, annotator and answers (nan for none)."""
    v = part.column(part.schema.get_field_index("v"))
    flat = v.flatten()
    row = np.repeat(np.arange(len(v)), np.diff(v.offsets.to_numpy()))
    return row, flat.field(0).to_numpy(), [flat.field(1 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(k)]


def _round(items: DataFrame, w: np.ndarray) -> np.ndarray:
    """(annotator, field, SUMS) of the distances to the others' consensus under the weights (annotator, field)."""
    m, k = w.shape
    names = [f"{s}{i}" for i in range(k) for s in SUMS]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros((m, k, len(SUMS)))
        for part in parts:
            row, code, answers = _flat(part, k)
            for i, a in enumerate(answers):
                has = ~np.isnan(a)
                r, c, x = row[has], code[has], a[has]
                own = w[c, i]
                s, t = np.bincount(r, own * x, part.num_rows)[r], np.bincount(r, own, part.num_rows)[r]
                ok = t - own > 1e-9 * t
                c, x, o = c[ok], x[ok], ((s - own * x)[ok]) / (t - own)[ok]
                for j, y in enumerate((None, (x - o) ** 2, x, x * x, o, o * o)):
                    got[:, i, j] += np.bincount(c, y, m)
        some = np.flatnonzero(got[:, :, 0].any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *map(pa.array, got[some].reshape(len(some), k * len(SUMS)).T)], ["code", *names])

    t = items.select("v").mapInArrow(run, "code int, " + ", ".join(f"{x} double" for x in names)).groupBy("code").agg(*[F.sum(x).alias(x) for x in names]).toArrow()
    out = np.zeros((m, k * len(SUMS)))
    if t.num_rows:
        out[t.column(0).to_numpy()] = np.stack([t.column(1 + j).to_numpy() for j in range(k * len(SUMS))], 1)
    return out.reshape(m, k, len(SUMS))


def _weighed(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, distances, chance) of :func:`_round`'s sums, as :func:`_weights` has them."""
    n0, d, x, xx, o, oo = np.moveaxis(sums, 2, 0)
    n = np.maximum(n0, 1)
    chance = (xx / n - (x / n) ** 2) + (oo / n - (o / n) ** 2) + (x / n - o / n) ** 2
    a = 2 / (9 * n)
    bound = (d + 0.01) / (n * np.maximum(1 - a - ALPHA_Z * np.sqrt(a), 1e-3) ** 3)
    return np.where((n0 > 0) & (bound * (1 + MARGIN) < chance), 1 / np.maximum(bound, 1e-6), 0.0), d / n, chance


def annotators(judged: DataFrame, most: int) -> list[str] | None:
    """The annotators in order, None if there are more than ``most``."""
    got = [r[0] for r in judged.where("item_id is not null and annotator is not null").select(F.col("annotator").cast("string")).distinct().limit(most + 1).collect()]
    return sorted(got) if len(got) <= most else None


def discover(items: DataFrame, m: int, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, int, float]:
    """(weights, sums, rounds, last movement) of packed items with ``m`` annotators and ``k`` fields."""
    w, far, sums, n = np.ones((m, k)), float("inf"), np.zeros((m, k, len(SUMS))), 0
    while n < rounds and far > TOLERANCE:
        sums = _round(items, w)
        new = _weighed(sums)[0]
        if n:
            total = new.sum(0)
            far = float((np.abs(new - w).sum(0) / np.where(total > 0, total, 1)).max(initial=0))
        w, n = new, n + 1
    return w, sums, n, far


def consensus(judged: DataFrame, fields: tuple[str, ...] = FIELDS, most: int = MOST) -> DataFrame:
    """(item_id, field, consensus, agreement, n_answers): one row an item and field with an answer.

    consensus is the weighted median of the answers, of booleans (0 and 1) the
    weighted majority; where exactly half the weight lies on either side, the
    mean of the two middle answers; null if only annotators without weight
    answered.  agreement is the share of weight whose answers lie on the
    consensus's side of the field's limit.  Null items and annotators are left
    out; an empty table gives none.
    """
    names = annotators(judged, most)
    if names is None:
        return _consensus_joined(judged, fields)
    k = len(fields)
    items = packed(judged, fields, names)
    w = discover(items, len(names), k)[0]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            row, code, answers = _flat(part, k)
            for i, (f, a) in enumerate(zip(fields, answers, strict=True)):
                levels, limit = np.array(LEVELS.get(f, (0, 1)), float), LIMIT.get(f, 0.5)
                has = ~np.isnan(a)
                n = np.bincount(row[has], minlength=part.num_rows)
                at = np.searchsorted(levels, np.floor(a + 0.5))
                ok = has & (at < len(levels))
                ok[ok] &= levels[at[ok]] == np.floor(a[ok] + 0.5)
                by = np.bincount(row[ok] * len(levels) + at[ok], w[code[ok], i], part.num_rows * len(levels)).reshape(-1, len(levels))
                upto, total = by.cumsum(1), by.sum(1)
                lower, upper = levels[(upto >= total[:, None] * (0.5 - 1e-9)).argmax(1)], levels[(upto > total[:, None] * (0.5 + 1e-9)).argmax(1)]
                c, on = (lower + upper) / 2, total > 0
                low = by[:, levels < limit].sum(1) / np.where(on, total, 1)
                side = np.where(c < limit, low, 1 - low)
                keep = np.flatnonzero(n > 0)
                value = lambda x: pa.array(x[keep], mask=~on[keep])  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), pa.array([f] * len(keep), pa.string()), value(c), value(side), pa.array(n[keep])], ["item_id", "field", "consensus", "agreement", "n_answers"])

    return items.mapInArrow(run, "item_id string, field string, consensus double, agreement double, n_answers long")


def _consensus_joined(judged: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The same for any number of annotators; answers are counted by level and item."""
    k = len(fields)
    v, w, *_ = discover_joined(judged, fields)
    j = v.join(w.select("annotator", *[f"w{i}" for i in range(k)]), "annotator")
    aggs = []
    for i, f in enumerate(fields):
        a = F.col(f"a{i}")
        aggs.append(F.count(a).alias(f"n{i}"))
        aggs += [F.sum(F.when(F.round(a) == x, F.col(f"w{i}")).otherwise(0.0)).alias(f"s{i}_{x}") for x in LEVELS.get(f, (0, 1))]
    g = j.groupBy("item_id").agg(*aggs)
    out = []
    for i, f in enumerate(fields):
        levels, limit = LEVELS.get(f, (0, 1)), LIMIT.get(f, 0.5)
        total = sum((F.col(f"s{i}_{x}") for x in levels), F.lit(0.0))
        lower, upper, upto = F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(0.0)
        for x in levels:
            upto = upto + F.col(f"s{i}_{x}")
            lower = F.coalesce(lower, F.when(upto >= total * (0.5 - 1e-9), F.lit(float(x))))
            upper = F.coalesce(upper, F.when(upto > total * (0.5 + 1e-9), F.lit(float(x))))
        c = F.when(total > 0, (lower + F.coalesce(upper, lower)) / 2)
        low = sum((F.col(f"s{i}_{x}") for x in levels if x < limit), F.lit(0.0)) / total
        out.append(F.struct(F.lit(f).alias("field"), c.alias("consensus"), F.when(c < limit, low).when(c.isNotNull(), 1 - low).alias("agreement"), F.col(f"n{i}").alias("n_answers")))
    return g.select("item_id", F.inline(F.array(*out))).where("n_answers > 0")


def reliability(judged: DataFrame, fields: tuple[str, ...] = FIELDS, most: int = MOST) -> DataFrame:
    """(annotator, field, weight, n_answers, distance, chance, rounds, moved): weight 0 marks those who must not decide.

    rounds is the number of rounds and moved the share of weight that the last one moved, over TOLERANCE only if ROUNDS ended it.
    """
    names, k = annotators(judged, most), len(fields)
    if names is None:
        _, t, n, far = discover_joined(judged, fields)
        out = [F.struct(F.lit(f).alias("field"), F.col(f"w{i}").alias("weight"), F.col(f"m{i}").alias("n_answers"), F.col(f"e{i}").alias("distance"), F.col(f"c{i}").alias("chance")) for i, f in enumerate(fields)]
        return t.select("annotator", F.inline(F.array(*out))).select("*", F.lit(n).alias("rounds"), F.lit(far).alias("moved"))
    w, sums, n, far = discover(packed(judged, fields, names), len(names), k)
    _, d, chance = _weighed(sums)
    rows = [(x, f, float(w[j, i]), int(sums[j, i, 0]), float(d[j, i]), float(chance[j, i]), n, far) for j, x in enumerate(names) for i, f in enumerate(fields)]
    return judged.sparkSession.createDataFrame(rows, "annotator string, field string, weight double, n_answers long, distance double, chance double, rounds int, moved double")


def found(judged: DataFrame) -> DataFrame:
    """p3: (item_id, field) of the items whose consensus is false, or below 3."""
    limit = F.create_map(*[F.lit(x) for f in FIELDS for x in (f, LIMIT[f])])
    return consensus(judged).where(F.col("consensus") < limit[F.col("field")]).select("item_id", "field")
