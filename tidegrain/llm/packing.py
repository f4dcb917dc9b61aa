"""Filling fixed-capacity containers with items by swap-based local search.

Items larger than a container are cut into full containers and a rest; nothing else is split. Items are dealt
by hash into shards of a bounded number of containers, one task each. A shard's items are put one after the other into
containers (next fit, which leaves about a fifth unused), then the search moves an item into another container,
exchanges one for one, or two for one, whenever that raises the sum of squared fills, until no exchange does. Raising
the sum of squares fills full containers further and empties the others, which then disappear. The sum is a whole
number that rises with every exchange and is bounded, so the search ends.

A shard is left with about one container that its items cannot fill. Containers filled under ``CARRIED`` are opened again
and their items dealt into fewer shards in a next round, until one shard takes them all: rounds grow with the
logarithm of the shards, and what they carry shrinks by about ``BINS_PER_SHARD`` each time.

Defined cases: items without a size or of size 0 take no container and are left out; items of exactly
the capacity fill one; repeated keys are packed as often as they occur; an empty table gives an empty
result; only named columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrain.session import written

CAPACITY = 1024
BINS_PER_SHARD = 1000
#: Share of a container under which it is opened again for the next round.
CARRIED = 0.95


def next_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item into the last bin, or a new one where it does not fit."""
    bins: list[list[int]] = []
    room = 0
    for i, s in enumerate(sizes):
        if s > room:
            bins.append([])
            room = capacity
        bins[-1].append(i)
        room -= s
    return bins


def improve(bins: list[list[int]], sizes: list[int], capacity: int, sweeps: int | None = None) -> list[list[int]]:
    """Local search on the underfull bins until no exchange raises the sum of squared fills, or for ``sweeps`` passes.

    Every bin gets the exchange that fills it most, found exactly: one heap of bins, emptiest first, per
    size of an item and per sum of two, and bit masks of the sizes that exist.
    """
    fill = [sum(sizes[i] for i in b) for b in bins]
    version = [0] * len(bins)
    heaps = [[[] for _ in range(capacity + 1)] for _ in range(2)]  # (fill, bin, version) by weight: of one item, of two
    live = [0, 0]  # bit w: the heap of weight w isn't empty

    def held(b: int) -> tuple[int, int]:
        """Masks of the sizes in a bin and of the sums of two."""
        counts = Counter(sizes[i] for i in bins[b])
        one = sum(1 << s for s in counts)
        two = 0
        for s, n in counts.items():
            two |= (one if n > 1 else one ^ (1 << s)) << s
        return one, two

    def offer(b: int) -> None:
        version[b] += 1
        if not bins[b] or fill[b] == capacity:
            return
        for m, mask in enumerate(held(b)):
            live[m] |= mask
            for w in _bits(mask):
                heapq.heappush(heaps[m][w], (fill[b], b, version[b]))

    def emptiest(m: int, w: int, a: int) -> int | None:
        """The emptiest bin but ``a`` that offers weight ``w``."""
        heap, own = heaps[m][w], None
        while heap and (heap[0][2] != version[heap[0][1]] or heap[0][1] == a):
            top = heapq.heappop(heap)
            own = top if top[1] == a and top[2] == version[a] else own
        found = heap[0][1] if heap else None
        if own:
            heapq.heappush(heap, own)
        if not heap:
            live[m] &= ~(1 << w)
        return found

    def best(a: int) -> tuple[int, int, int, int] | None:
        """(gain, bin, weight taken, items taken) of the exchange that fills ``a`` most."""
        one, two = held(a)
        for gain in range(capacity - fill[a], 0, -1):
            for m, given in ((0, 1 | one | two), (1, 1 | one)):  # two for two is left out
                for w in _bits((given << gain) & live[m]):
                    b = emptiest(m, w, a)
                    if b is not None and fill[b] < fill[a] + gain:
                        return gain, b, w, m + 1
        return None

    def pick(b: int, weight: int, most: int) -> list[int]:
        """At most ``most`` items of a bin that weigh ``weight`` together."""
        if not weight:
            return []
        at: dict[int, int] = {}
        for i in bins[b]:
            if sizes[i] == weight:
                return [i]
        for i in bins[b] if most > 1 else []:
            if weight - sizes[i] in at:
                return [at[weight - sizes[i]], i]
            at[sizes[i]] = i
        raise ValueError("not in the bin")

    for b in range(len(bins)):
        offer(b)
    passed = 0
    while sweeps is None or passed < sweeps:
        passed, done = passed + 1, 0
        for a in sorted((b for b in range(len(bins)) if bins[b] and fill[b] < capacity), key=lambda b: -fill[b]):
            found = best(a) if bins[a] and fill[a] < capacity else None
            if found:
                gain, b, weight, most = found
                items, out = pick(b, weight, most), pick(a, weight - gain, 3 - most)
                bins[a] = [i for i in bins[a] if i not in out] + items
                bins[b] = [i for i in bins[b] if i not in items] + out
                fill[a] += gain
                fill[b] -= gain
                offer(a)
                offer(b)
                done += 1
        if not done:
            break
    return [b for b in bins if b]


def _bits(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def _pack_shard(capacity: int, sweeps: int | None, turn: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "key", "piece"], kind="stable").reset_index(drop=True)
        sizes = pdf["size"].tolist()
        bins = improve(next_fit(sizes, capacity), sizes, capacity, sweeps)
        container, fill, shard = [0] * len(sizes), [0] * len(sizes), int(pdf["shard"].iloc[0])
        for n, b in enumerate(bins):
            used = sum(sizes[i] for i in b)
            for i in b:
                container[i], fill[i] = (turn << 56) + (shard << 24) + n, used
        return pdf[["key", "piece", "size"]].assign(container=container, fill=fill)

    return run


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, bins_per_shard: int = BINS_PER_SHARD, sweeps: int | None = None) -> DataFrame:
    """``(key, piece, size, container)``: where each item, or each piece of an oversized one, goes.

    Containers of full pieces have numbers below 0.
    """
    kind = items.schema[key].dataType.simpleString()
    rows = items.where(F.col(size) > 0).select(F.col(key).alias("key"), F.col(size).cast("bigint").alias("size"))
    pieces = F.ceil(F.col("size") / capacity).cast("int")
    parts = F.transform(F.sequence(F.lit(0), pieces - 1), lambda p: F.struct(p.alias("piece"), F.least(F.lit(capacity).cast("bigint"), F.col("size") - p * capacity).alias("size")))
    rows = rows.select("key", F.explode(parts).alias("c")).select("key", "c.piece", "c.size")
    done = rows.where(F.col("size") == capacity).withColumn("container", -1 - F.monotonically_increasing_id())
    todo, turn, schema = rows.where(F.col("size") < capacity), 0, f"key {kind}, piece int, size bigint, container bigint, fill bigint"
    total = todo.agg(F.sum("size")).first()[0] or 0
    while True:
        shards = max(1, math.ceil(total / (capacity * bins_per_shard)))
        order = F.xxhash64("key", "piece", "size", F.lit(turn))
        dealt = todo.withColumn("order", order).withColumn("shard", F.pmod(F.shiftright("order", 8), F.lit(shards)).cast("int"))
        packed = dealt.groupBy("shard").applyInPandas(_pack_shard(capacity, sweeps, turn), schema)
        if shards == 1:
            return done.unionByName(packed.drop("fill")).withColumnRenamed("key", key)
        packed = written(packed)
        kept = F.col("fill") >= CARRIED * capacity
        done = done.unionByName(packed.where(kept).drop("fill"))
        todo, turn = packed.where(~kept).select("key", "piece", "size"), turn + 1
        before, total = total, todo.agg(F.sum("size")).first()[0] or 0
        if total * 2 > before:  # items that fill no container well gain nothing from another deal
            return done.unionByName(packed.where(~kept).drop("fill")).withColumnRenamed("key", key)
