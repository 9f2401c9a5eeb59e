"""Filling containers of fixed capacity with items, by harmonic packing (problem 8).

An item of size t belongs to reciprocal class k = capacity // t: k of the class always fit one container. Every worker fills
its own containers from its own items, in batches: items of class 1 open a container each and their remaining room is topped up
with the largest items that fit; then each other class is filled k items a container. Items of the last class, below
capacity / classes, are filled by first fit in falling size. Items short of a full count wait for the next batch; those of the
last batch are packed with its last class, so that a worker leaves about one container partly filled. No shuffle, no group: a
class or source that holds a third of all items is just more containers.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftnet.runtime import spread

CLASSES = 12
BATCH = 20_000


def cut_oversized(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, size) of the pieces: whole items, and items above the capacity in pieces of it with a remainder."""
    n = np.maximum(1, -(-sizes // capacity))
    row = np.repeat(np.arange(len(sizes)), n)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = piece * capacity
    return row, start, np.minimum(sizes[row] - start, capacity)


class Packer:
    """One worker's containers for one capacity."""

    def __init__(self, capacity: int, classes: int = CLASSES):
        self.capacity, self.classes, self.made = capacity, classes, 0
        self.waiting: list[tuple[int, int]] = []  # (size, item), below one container a class

    def _open(self, count: int = 1) -> int:
        self.made += count
        return self.made - count

    def _top_up(self, rooms: list[tuple[int, int]], items: list[tuple[int, int]], out: dict[int, int]) -> list[tuple[int, int]]:
        """Fill rooms (size, container) with the largest items that fit, tightest room first; the items left come back."""
        sizes = [s for s, _ in items]  # ascending
        for room, box in sorted(rooms):
            while sizes and sizes[0] <= room:
                at = bisect_right(sizes, room) - 1
                room -= sizes.pop(at)
                out[items.pop(at)[1]] = box
        return items

    def add(self, items: list[tuple[int, int]], last: bool) -> dict[int, int]:
        """Containers by item, for the new items and those that waited; without ``last`` some may go on waiting."""
        out: dict[int, int] = {}
        items = sorted(items + self.waiting)
        self.waiting = []
        cap = self.capacity
        big = [x for x in items if x[0] * 2 > cap]
        rooms = []
        for size, item in big:
            out[item] = box = self._open()
            if size < cap:
                rooms.append((cap - size, box))
        rest = self._top_up(rooms, [x for x in items if x[0] * 2 <= cap], out)
        by_class: dict[int, list[tuple[int, int]]] = {}
        for x in rest:
            by_class.setdefault(min(cap // x[0], self.classes), []).append(x)
        for k in sorted(by_class):
            own = by_class[k]
            full = len(own) // k * k if k < self.classes else 0
            rooms = []
            for i in range(0, full, k):
                box = self._open()
                out.update((item, box) for _, item in own[i : i + k])
                rooms.append((cap - sum(s for s, _ in own[i : i + k]), box))
            smaller = sorted(x for c, xs in by_class.items() if c > k for x in xs)
            if full and smaller:  # what a fixed count leaves free takes smaller items
                left = self._top_up(rooms, smaller, out)
                for c in list(by_class):
                    if c > k:
                        by_class[c] = []
                for x in left:
                    by_class[min(cap // x[0], self.classes)].append(x)
            self.waiting += own[full:] if k < self.classes else []
        tail = by_class.get(self.classes, [])
        if last:
            tail, self.waiting = sorted(tail + self.waiting), []
        return self._first_fit(tail, out)

    def _first_fit(self, items: list[tuple[int, int]], out: dict[int, int]) -> dict[int, int]:
        """First fit in falling size over a tree of the largest rooms; items are at most a batch and what waited."""
        n = 1
        while n < max(1, len(items)):
            n *= 2
        tree = [self.capacity] * (2 * n)
        base = self.made
        for size, item in reversed(items):
            at = 1
            while at < n:
                at = 2 * at if tree[2 * at] >= size else 2 * at + 1
            tree[at] -= size
            out[item] = base + at - n
            self.made = max(self.made, base + at - n + 1)
            while at > 1:
                at //= 2
                tree[at] = max(tree[2 * at], tree[2 * at + 1])
        return out


def pack(df: DataFrame, key: str, size, capacities: dict[str, int], classes: int = CLASSES) -> DataFrame:
    """Columns limit_name, container_id, item_id, piece, start, size: every item in a container of every capacity.

    Items above a capacity are cut into pieces of it, the last one shorter; others are whole. Items of size zero (null or
    empty) take no room and come with a null container. Keys may be null or repeat: each row is an item. Equal sizes are
    packed in any order. An empty table gives no rows. container_id is unique within a limit.
    """
    items = spread(df.select(F.col(key).alias("item_id"), F.coalesce(size, F.lit(0)).cast("long").alias("size")))
    kind = items.schema["item_id"].dataType.simpleString()
    schema = f"limit_name string, container_id long, item_id {kind}, piece int, start long, size long"
    names = sorted(capacities)
    return items.mapInPandas(lambda batches: _pack_partition(batches, [(n, int(capacities[n])) for n in names], classes), schema)


def _pack_partition(batches: Iterator[pd.DataFrame], limits: Sequence[tuple[str, int]], classes: int) -> Iterator[pd.DataFrame]:
    first = TaskContext.get().partitionId() << 40
    packers = [Packer(c, classes) for _, c in limits]
    held: list[dict[int, tuple]] = [{} for _ in limits]  # what waits, by item number
    numbers = [0] * len(limits)
    batch: list[pd.DataFrame] = []
    rows = 0

    def emit(last: bool) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(batch, ignore_index=True) if batch else None
        keys = pdf["item_id"].to_numpy() if batch else np.array([], dtype=object)
        sizes = pdf["size"].to_numpy() if batch else np.zeros(0, np.int64)
        for q, ((name, cap), packer) in enumerate(zip(limits, packers, strict=True)):
            row, start, size = cut_oversized(sizes, cap)
            out = []
            new = []
            known = held[q]
            for r, s, n in zip(row.tolist(), start.tolist(), size.tolist(), strict=True):
                if n == 0:
                    out.append((None, keys[r], 0, 0, 0))
                else:
                    known[numbers[q]] = (keys[r], s // cap, s, n)
                    new.append((n, numbers[q]))
                    numbers[q] += 1
            for item, box in packer.add(new, last).items():
                out.append((first + box, *known.pop(item)))
            if out:
                boxes, ids, pieces, starts, ns = zip(*out, strict=True)
                yield pd.DataFrame({"limit_name": name, "container_id": pd.array(boxes, dtype="Int64"), "item_id": list(ids), "piece": pieces, "start": starts, "size": ns})

    for pdf in batches:
        batch.append(pdf)
        rows += len(pdf)
        if rows >= BATCH:
            yield from emit(False)
            batch, rows = [], 0
    yield from emit(True)
