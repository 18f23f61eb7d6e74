"""Filling containers of fixed capacity (problem 8).

The plan is made on the sizes' counts, of which there are no more than the
capacity, whatever the number of items; items are put into it afterwards, in
parallel.  Linear grouping: sizes above SMALL are put in order and cut into
groups of equal cardinality, and every size of a group counts as its
largest.  For these few sizes the configuration programme is solved by column
generation (a revised simplex whose columns come from a knapsack over the
capacity) and rounded down; what the rounding leaves is packed best-fit.  Then
the actual sizes take the places of the rounded ones, which leaves the room
they don't need, and the small items are filled in by best fit, largest first,
into whatever container has least room to spare.

An item larger than the capacity is cut into full containers and a rest, which
is an item like any other; no other item is cut.
"""

from __future__ import annotations

import bisect
import warnings
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from uttera.session import stage

CAPACITY = 2048
#: Numbers of groups that are tried; the plan of fewest containers counts.
GROUPS = (48, 96, 128, 192)
#: Sizes up to capacity / SMALL are filled in last.
SMALL = 8
BUCKETS = 512


def linear_groups(sizes: np.ndarray, counts: np.ndarray, groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Sizes (ascending) in groups of equal cardinality, largest first: (rounded size, [(size, count), ...])."""
    total, out = int(counts.sum()), []
    if not total:
        return []
    each = -(-total // groups)
    run: list[tuple[int, int]] = []
    held = 0
    for s, c in zip(sizes[::-1].tolist(), counts[::-1].tolist(), strict=True):
        while c:
            n = min(c, each - held)
            run.append((s, n))
            held, c = held + n, c - n
            if held == each:
                out.append((run[0][0], run))
                run, held = [], 0
    if run:
        out.append((run[0][0], run))
    return out


def best_pattern(sizes: list[int], value: np.ndarray, most: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity, none taken more often than there are items of it."""
    best = np.zeros(capacity + 1)
    took = []
    for s, v, m in zip(sizes, value, most, strict=True):
        n = np.zeros(capacity + 1, np.int32)
        if v > 1e-12:
            new = best.copy()
            for k in range(1, min(int(m), capacity // s) + 1):
                x = best[: capacity + 1 - k * s] + k * v
                better = x > new[k * s :] + 1e-12
                new[k * s :][better] = x[better]
                n[k * s :][better] = k
            best = new
        took.append(n)
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    for i in range(len(sizes) - 1, -1, -1):
        pattern[i] = took[i][room]
        room -= int(pattern[i]) * sizes[i]
    return float(best[capacity]), pattern


def configurations(sizes: list[int], demand: np.ndarray, capacity: int, rounds: int = 5000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often to use each, from the linear programme of the fewest containers.

    Rounds end at the optimum; should ``rounds`` end them, which a warning tells,
    the patterns are valid all the same but may need more containers.
    """
    k = len(sizes)
    cols = [np.eye(k, dtype=np.int64)[i] * max(1, min(capacity // sizes[i], int(demand[i]))) for i in range(k)]
    inv = np.diag([1.0 / c[i] for i, c in enumerate(cols)])
    x = inv @ demand
    for _ in range(rounds):
        dual = inv.sum(0)
        value, pattern = best_pattern(sizes, np.maximum(dual, 0), demand, capacity)
        if value <= 1 + 1e-7:
            break
        d = inv @ pattern
        can = d > 1e-10
        if not can.any():
            break
        ratio = np.where(can, x / np.where(can, d, 1), np.inf)
        r = int(ratio.argmin())
        step = max(ratio[r], 0.0)
        x = np.maximum(x - step * d, 0)
        x[r] = step
        row = inv[r] / d[r]
        inv = inv - np.outer(d, row)
        inv[r] = row
        cols[r] = pattern
    else:
        warnings.warn(f"the plan is not optimal after {rounds} rounds", stacklevel=2)
    return [(c, float(v)) for c, v in zip(cols, x, strict=True) if v > 1e-9]


class Plan:
    """Ranges of items by size and rank, each with its containers."""

    def __init__(self, capacity: int):
        self.capacity, self.used = capacity, 0
        self.ranges: list[tuple[int, int, int, int, int, int]] = []  # size, first rank, count, first container, items each, offset
        self.next: dict[int, int] = defaultdict(int)
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> runs of containers with it: first, count
        self.rooms: list[int] = []

    def take(self, size: int, count: int, container: int, each: int = 1, offset: int = 0) -> None:
        self.ranges.append((size, self.next[size], count, container, each, offset))
        self.next[size] += count

    def free(self, room: int, first: int, count: int) -> None:
        if room > 0 and count > 0:
            if not self.room[room]:
                bisect.insort(self.rooms, room)
            self.room[room].append((first, count))

    def open(self, count: int) -> int:
        first, self.used = self.used, self.used + count
        return first

    def best_fit(self, size: int, count: int) -> None:
        """Puts ``count`` items of ``size`` where least room would be left, one a container and turn, then into new containers."""
        while count:
            i = bisect.bisect_left(self.rooms, size)
            if i == len(self.rooms):
                break
            room = self.rooms[i]
            runs = self.room[room]
            first, n = runs.pop()
            if not runs:
                self.rooms.pop(i)
            each = max(1, min(room // size, count // n)) if n <= count else 1
            m = min(n, count)
            self.take(size, m * each, first, each, self.capacity - room)
            count -= m * each
            self.free(room - each * size, first, m)
            self.free(room, first + m, n - m)
        if count:
            each = self.capacity // size
            full = count // each
            first = self.open(full)
            if full:
                self.take(size, full * each, first, each)
                self.free(self.capacity - each * size, first, full)
            if rest := count - full * each:
                first = self.open(1)
                self.take(size, rest, first, rest)
                self.free(self.capacity - rest * size, first, 1)


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> Plan:
    """The best plan of several numbers of groups; one that no packing can go below ends the search."""
    least, best = -(-sum(s * c for s, c in counts.items() if 0 < s <= capacity) // capacity), None
    for g in groups:
        p = plan_of(counts, capacity, g)
        best = p if best is None or p.used < best.used else best
        if best.used <= least:
            break
    return best


def plan_of(counts: dict[int, int], capacity: int, groups: int) -> Plan:
    """The containers of items whose sizes, from 1 to the capacity, occur ``counts`` times."""
    out = Plan(capacity)
    left = {s: c for s, c in counts.items() if c > 0 and 0 < s <= capacity}
    large = sorted(s for s in left if s > capacity // SMALL)
    grouped = linear_groups(np.array(large, np.int64), np.array([left[s] for s in large], np.int64), groups)
    # groups of one rounded size are one
    merged: dict[int, list[tuple[int, int]]] = {}
    for s, run in grouped:
        merged.setdefault(s, []).extend(run)
    sizes = sorted(merged, reverse=True)
    demand = np.array([sum(c for _, c in merged[s]) for s in sizes], np.int64)
    runs = {s: [list(x) for x in merged[s]] for s in sizes}
    if sizes:
        for pattern, times in sorted(configurations(sizes, demand, capacity), key=lambda x: -x[1]):
            n = int(times + 1e-9)
            if not n:
                continue
            first = out.open(n)
            # each slot of the pattern takes n items of its group; the fill is a step function along the containers
            steps = [(0, n, 0)]
            for i, s in enumerate(sizes):
                for _ in range(int(pattern[i])):
                    at, new = 0, []
                    queue = runs[s]
                    while at < n:
                        if not queue:  # the last pattern of a group may ask for more than there are
                            new += [(a, b, f) for a, b, f in _cut(steps, at, n)]
                            break
                        size, c = queue[0]
                        m = min(c, n - at)
                        for a, b, f in _cut(steps, at, at + m):
                            out.take(size, b - a, first + a, 1, f)
                            new.append((a, b, f + size))
                        queue[0][1] -= m
                        if not queue[0][1]:
                            queue.pop(0)
                        at += m
                    steps = new
            for a, b, f in steps:
                out.free(capacity - f, first + a, b - a)
    rest: dict[int, int] = defaultdict(int)
    for s in sizes:
        for size, c in runs[s]:
            rest[size] += c
    for s in left:
        if s <= capacity // SMALL:
            rest[s] += left[s]
    for s in sorted(rest, reverse=True):
        out.best_fit(s, rest[s])
    return out


def _cut(steps: list[tuple[int, int, int]], a: int, b: int) -> list[tuple[int, int, int]]:
    return [(max(x, a), min(y, b), f) for x, y, f in steps if x < b and y > a]


def pieces_of(items: DataFrame, capacity: int) -> DataFrame:
    """(id, part, begin, size): items larger than the capacity in full parts and a rest; sizes of 0 or null have no part."""
    n = F.col("size").cast("long")
    cut = items.select("id", n.alias("n")).where("n > 0")
    whole = F.expr(f"transform(sequence(0L, (n - 1) div {capacity}L), i -> struct(cast(i as int) as part, i * {capacity}L as begin, least({capacity}L, n - i * {capacity}L) as size))")
    return cut.select("id", F.inline(whole))


def pack(items: DataFrame, capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> DataFrame:
    """(id, part, begin, size, container, place) of ``items`` (id, size), ids unique.

    part counts an item's parts from 0 and begin is the part's first unit in the
    item; place is its first unit in the container.  Items of size 0 or null
    take no room: one row with container null.  The same sizes give the same
    containers; among items of one size the hash of the id decides.  An empty
    table has none.
    """
    items = stage(items.select("id", F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size")))
    parts = pieces_of(items, capacity).withColumn("bucket", F.pmod(F.xxhash64("id", "part"), F.lit(BUCKETS)).cast("int"))
    by = stage(parts.groupBy("size", "bucket").agg(F.count("*").alias("n")))
    counts = {r[0]: r[1] for r in by.groupBy("size").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    p = plan(counts, capacity, groups)
    table = np.array(sorted(p.ranges) or [(0, 0, 0, 0, 1, 0)], np.int64)
    key = table[:, 0] << 44 | table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column("size").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(key, size << 44 | rank, "right") - 1
            k = rank - table[i, 1]
            container = table[i, 3] + k // table[i, 4]
            at = table[i, 5] + k % table[i, 4] * size
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "part", "begin", "size")), pa.array(container), pa.array(at)], ["id", "part", "begin", "size", "container", "place"])

    before = F.sum("n").over(Window.partitionBy("size").orderBy("bucket")) - F.col("n")  # at most BUCKETS rows a size
    # a hot size is spread over BUCKETS tasks; the counts by bucket are small: capacity x BUCKETS rows at most
    ranked = parts.withColumn("k", F.row_number().over(Window.partitionBy("size", "bucket").orderBy("id", "part")) - 1).join(by.withColumn("before", before).drop("n"), ["size", "bucket"])
    kind = dict(items.dtypes)["id"]
    placed = ranked.select("id", "part", "begin", "size", (F.col("before") + F.col("k")).cast("long").alias("rank")).mapInArrow(place, f"id {kind}, part int, begin long, size long, container long, place long")
    none = items.where("size <= 0").select("id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("begin"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("container"), F.lit(None).cast("long").alias("place"))
    return placed.unionByName(none)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row (n_containers, n_units, least, fill): least is the number of containers that no packing can go below by size."""
    got = packed.where("container is not null").agg(F.coalesce(F.max("container") + 1, F.lit(0)).alias("n_containers"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_units"))
    return got.select("n_containers", "n_units", F.ceil(F.col("n_units") / capacity).alias("least"), (F.col("n_units") / (F.greatest("n_containers", F.lit(1)) * capacity)).alias("fill"))
