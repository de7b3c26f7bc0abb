"""Best-fit packing into bins of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Permitted sequence lengths, and pieces that one group packs on its own.
CAPACITIES, PER_GROUP = (512, 2048, 8192), 50_000
#: Tokens that opening a bin costs, and the length at which a token's attention costs as much as all else that it costs.
OVERHEAD, ATTENTION = 8.0, 32_768.0


def price(capacity: int, overhead: float = OVERHEAD, attention: float = ATTENTION) -> float:
    """What a training sequence of this length costs, in tokens: its length, a fixed part, and attention, which is quadratic."""
    return capacity + overhead + capacity * capacity / attention


def pack(lengths: Sequence[int], capacities: Sequence[int], cost: Callable[[int], float] = price) -> list[tuple[int, int, int, int]]:
    """(bin, offset, capacity, load) for each of lengths, which descend and are between 1 and the largest capacity.

    A piece goes to the bin with the least room that takes it. If none does, a bin opens with the permitted length that costs least
    for each token that it can be expected to hold: the piece, and of the pieces still to come those that fit beside it, as far as
    there is room; ties open the longer one. Short lengths cost less attention, long ones suit pieces that leave short ones half
    empty. All lengths are tried jointly, and so are the longer ones alone; the packing that costs least stays, ties the one of
    more lengths. At the end each bin shrinks to the least permitted length that holds its contents.
    """
    sizes = sorted(set(capacities))
    found = [_packed(lengths, sizes, sizes[i:], cost) for i in range(len(sizes))]
    return min(found, key=lambda x: x[0])[1]


def _packed(lengths: Sequence[int], sizes: list[int], opened: list[int], cost: Callable[[int], float]) -> tuple[float, list[tuple[int, int, int, int]]]:
    rooms: list[int] = []  # distinct rooms of open bins, ascending
    bins_with: dict[int, list[int]] = {}
    load: list[int] = []
    at: list[tuple[int, int]] = []
    rest = [0, *accumulate(reversed(lengths))]  # tokens of the shortest pieces
    rising = lengths[::-1]
    for j, n in enumerate(lengths):
        i = bisect_left(rooms, n)
        if i < len(rooms):
            room = rooms[i]
            own = bins_with[room]
            b = own.pop()
            if not own:
                del bins_with[room]
                rooms.pop(i)
        else:
            to_come = len(lengths) - j - 1
            room = min((c for c in opened if c >= n), key=lambda c: (cost(c) / (n + min(c - n, rest[min(to_come, bisect_right(rising, c - n))])), -c))
            b = len(load)
            load.append(0)
        at.append((b, load[b]))
        load[b] += n
        room -= n
        if room:
            if room not in bins_with:
                bins_with[room] = []
                insort(rooms, room)
            bins_with[room].append(b)
    fit = [sizes[bisect_left(sizes, x)] for x in load]
    return sum(map(cost, fit)), [(b, off, fit[b], load[b]) for b, off in at]


def best_fit(docs: DataFrame, length: Column, key: Sequence[str], capacities: Sequence[int] = CAPACITIES, per_group: int = PER_GROUP) -> DataFrame:
    """One row for each piece of each document: the columns of key, piece, start, length, bin_id, bin_offset, bin_capacity, bin_load.

    Documents longer than the largest capacity are cut into pieces of it and a rest, so nothing is dropped. Pieces are dealt
    by a hash of key into groups of about per_group, as many as the input needs, and each group is packed by pack(): memory
    is bounded, and the waste of a group's last bins is negligible against its size. Rows with equal keys are told apart by
    their order. Documents of null length or 0 have no pieces. Results depend on the rows alone. No rows give no rows.
    """
    most = max(capacities)
    names = [f"k{i}" for i in range(len(key))]
    slim = docs.select(*[docs[c].alias(n) for c, n in zip(key, names)], F.coalesce(length, F.lit(0)).cast("long").alias("size")).where(F.col("size") > 0)
    # Equal rows are one row with a count until they are dealt, so a group of copies can't fill a task.
    slim = written(slim.groupBy(*names, "size").agg(F.count("*").alias("copies")), "pack")
    pieces = slim.agg(F.sum(F.col("copies") * F.ceil(F.col("size") / most))).first()[0] or 0
    groups = max(1, -(-pieces // per_group))
    cut = slim.select(*names, "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    cut = cut.select(*names, "copy", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / most) - 1)).alias("piece"))
    cut = cut.select(*names, "copy", "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most).cast("long"), F.col("size") - F.col("piece") * most).alias("length"))
    cut = cut.withColumn("pid", F.pmod(F.xxhash64(*names, "copy", "piece"), F.lit(groups)))
    order = [*names, "copy", "piece"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", *order], ascending=[False] + [True] * len(order), kind="stable", ignore_index=True)
        got = pack(pdf["length"].tolist(), capacities)
        pid = int(pdf["pid"].iloc[0])
        out = pdf[[*names, "copy", "piece", "start", "length"]].copy()
        out["bin_id"] = [f"{pid}-{b}" for b, _, _, _ in got]
        out["bin_offset"], out["bin_capacity"], out["bin_load"] = [x[1] for x in got], [x[2] for x in got], [x[3] for x in got]
        return out

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name != "pid"] + ["bin_id string, bin_offset bigint, bin_capacity bigint, bin_load bigint"])
    out = cut.groupBy("pid").applyInPandas(run, schema)
    return out.withColumnsRenamed(dict(zip(names, key)))
