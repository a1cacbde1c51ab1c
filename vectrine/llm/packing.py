"""Filling fixed-capacity containers with items.

Method: non-negative least squares over the histogram of sizes.  Combinations
of up to ``depth`` size bins that fill the capacity to within a window are
enumerated, repeat counts are solved against the histogram and rounded down,
and what remains is packed greedily: the largest size that fits goes into each
open space, then new containers are opened.

Only the histogram (one row a size, so at most ``capacity`` rows) reaches the
driver.  The plan says which positions of each size go to which containers;
items find theirs by their position among the items of their size, counted
within salts, so no size gathers in one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrine.plans.materialize import Scratch, sized


#: Items of one size and salt that a task numbers, at most about.
SALT_ROWS = 1 << 22


@dataclass(frozen=True)
class PackConfig:
    capacity: int = 2048
    depth: int = 3
    bins: int = 64
    #: Bins that a combination may leave empty.
    window: int = 1
    salts: int = 64


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 of about the least |a x - b|, by an active set; a's columns are combinations."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[free] = -np.inf
        j = int(gradient.argmax())
        if gradient[j] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        free[j] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if s[free].min() > 0:
                x = s
                break
            low = free & (s <= 0)
            step = np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))
            x = x + step * (s - x)
            free &= x > 1e-12
            x[~free] = 0
            if not free.any():
                break
    return x


class _Plan:
    """Segments (size, first position, items, first container, items a container)."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        self.used = np.zeros_like(self.left)
        self.segments: list[tuple[int, int, int, int, int]] = []
        self.containers = 0
        self.spaces: list[tuple[int, int, int]] = []  # (space, first container, containers)

    def put(self, size: int, items: int, container: int, each: int) -> None:
        self.segments.append((size, int(self.used[size]), items, container, each))
        self.used[size] += items
        self.left[size] -= items

    def open(self, number: int) -> int:
        first = self.containers
        self.containers += number
        return first


def plan(counts: np.ndarray, cfg: PackConfig) -> _Plan:
    """Where the items of each size go; ``counts[s]`` items have the size s, from 1 to the capacity."""
    p = _Plan(counts)
    cap = cfg.capacity
    width = -(-cap // cfg.bins)
    bins = -(-cap // width)
    of = -(-np.arange(cap + 1) // width)  # sizes are rounded up to whole bins, so a full combination fits
    histogram = np.bincount(of[1:], weights=p.left[1:], minlength=bins + 1)[1 : bins + 1]
    full = cap // width
    combos = [c for d in range(1, cfg.depth + 1) for c in combinations_with_replacement(range(1, bins + 1), d) if full - cfg.window <= sum(c) <= full]
    combos = [c for c in combos if all(histogram[b - 1] for b in c)]
    if combos:
        a = np.zeros((bins, len(combos)))
        for j, c in enumerate(combos):
            for b in c:
                a[b - 1, j] += 1
        weight = np.arange(1, bins + 1, dtype=float)[:, None]  # an unpacked large item costs more
        repeats = np.floor(nnls(a * weight, histogram * weight[:, 0])).astype(np.int64)
        for j in np.argsort(-repeats, kind="stable"):
            c, r = combos[j], int(repeats[j])
            while r > 0:
                # sizes at hand in each bin, the largest first; runs of equal choices are one segment
                pick, need, ok = [], {}, True
                for b in c:
                    sizes = [s for s in range(min(cap, b * width), (b - 1) * width, -1) if p.left[s] > need.get(s, 0)]
                    if not sizes:
                        ok = False
                        break
                    pick.append(sizes[0])
                    need[sizes[0]] = need.get(sizes[0], 0) + 1
                if not ok:
                    break
                t = min(r, *(int(p.left[s]) // k for s, k in need.items()))
                first = p.open(t)
                for s, k in need.items():
                    p.put(s, t * k, first, k)
                if (space := cap - sum(pick)) > 0:
                    p.spaces.append((space, first, t))
                r -= t
    _greedy(p, cap)
    return p


def _greedy(p: _Plan, cap: int) -> None:
    spaces = sorted(p.spaces, key=lambda x: x[0])
    while True:
        stack = spaces
        spaces = []
        while stack:
            space, first, number = stack.pop()
            have = np.flatnonzero(p.left[1 : space + 1])
            if len(have) == 0:
                continue
            s = int(have[-1]) + 1
            each, n = space // s, int(p.left[s])
            if n < each:
                t, each = 1, n
            else:
                t = min(number, n // each)
            p.put(s, t * each, first, each)
            if number > t:
                stack.append((space, first + t, number - t))
            if space - each * s > 0:
                stack.append((space - each * s, first, t))
        have = np.flatnonzero(p.left[1:])
        if len(have) == 0:
            return
        s = int(have[-1]) + 1
        number = max(1, int(p.left[s]) // (cap // s))
        spaces = [(cap, p.open(number), number)]


def _place(segments: np.ndarray, containers: int):
    order = np.lexsort((segments[:, 1], segments[:, 0]))
    seg = segments[order]
    key = seg[:, 0] * (1 << 46) + seg[:, 1]

    def run(batches):
        for b in batches:
            size, at = b.column("size").to_numpy(), b.column("at").to_numpy()
            j = np.searchsorted(key, size * (1 << 46) + at, side="right") - 1
            out = seg[j, 3] + (at - seg[j, 1]) // np.maximum(seg[j, 4], 1)
            # an item of no size takes no space: those are spread over all containers
            out = np.where(size > 0, out, at % max(1, containers))
            yield pa.record_batch([pa.array(out), b.column("id"), b.column("piece_no"), b.column("start"), b.column("size")], ["container", "id", "piece_no", "start", "size"])

    return run


def fill_containers(df: DataFrame, record: Column, size: Column, cfg: PackConfig = PackConfig()) -> DataFrame:
    """(container, id, piece_no, start, size): every item, or piece of an item above the capacity, in a container.

    The sizes in a container add up to the capacity at most.  An item above the
    capacity is divided into full containers and a rest; no other is divided.
    An item of size 0, or of a null or negative size (taken as 0), is placed
    too and takes no space.  Every row is an item, repeated and null ids
    included.  An empty table gives an empty result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    cap = cfg.capacity
    items = df.select(record.alias("id"), F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    pieces = items.withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / cap) - 1, F.lit(0)).cast("int")))).select(
        "id", "piece_no", (F.col("piece_no") * F.lit(cap).cast("long")).alias("start"), F.least(F.lit(cap), F.col("n") - F.col("piece_no") * cap).cast("long").alias("size")
    )
    pieces = scratch.cut(pieces)
    salts = max(cfg.salts, pieces.count() // SALT_ROWS)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece_no"), F.lit(salts)).cast("int"))
    count = salted.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("items")).toArrow()  # at most (capacity + 1) * salts rows
    s, salt, n = (count.column(c).to_numpy() for c in ("size", "salt", "items"))
    order = np.lexsort((salt, s))
    s, salt, n = s[order], salt[order], n[order]
    before = np.cumsum(n) - n
    first = before - before[np.searchsorted(s, s)] if len(s) else before  # within the size
    counts = np.bincount(s, weights=n, minlength=cap + 1).astype(np.int64)
    counts[0] = 0
    p = plan(counts, cfg)
    offsets = sized(spark.createDataFrame(pa.table({"size": pa.array(s, pa.int64()), "salt": pa.array(salt, pa.int32()), "first": pa.array(first, pa.int64())})), len(s))
    within = Window.partitionBy("size", "salt").orderBy("id", "piece_no")
    at = salted.withColumn("r", F.row_number().over(within)).join(offsets, ["size", "salt"]).select("id", "piece_no", "start", "size", (F.col("first") + F.col("r") - 1).alias("at"))
    segments = np.array(p.segments or [(cap + 1, 0, 0, 0, 1)], np.int64)
    kind = at.schema["id"].dataType.simpleString()
    return at.mapInArrow(_place(segments, p.containers), f"container long, id {kind}, piece_no int, start long, size long")
