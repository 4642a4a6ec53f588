"""Sharding by minimax contiguous partition of atomic groups.

Groups are rows of equal text; they are never divided. In the order of their text hash they
are cut into contiguous shards whose largest size is as small as it can be: the capacity is
binary-searched, a greedy pass telling whether it suffices, and the greedy cuts at the
smallest one are taken. A group of at least an even share of what is left gets a shard of its
own first, so that the others stay near equal.

The driver never holds all groups. It holds cells, ranges of the hash order with their size
and number of groups, at first 2^16. The greedy pass may divide a cell of several groups,
which can only lower the capacity; where the passing cuts divide none, they are real and the
capacity is exact. Otherwise the cells around those cuts are read again, 256 times finer.

A row's place in its shard comes from a range partition by shard, hash and id, so a shard or
a group of any size is spread over tasks; only each task's counts are added up. A null text
counts as empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.llm.common import cut

SHARDS = 16
_TOP = 48  # bits of the hash below the first cells
_STEP = 8
_AROUND = 8


class Cells:
    """Ranges of hashes in order: low bound, shift (range of 2^shift), size, groups."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        rows = sorted(rows)
        self.low = [r[0] for r in rows]
        self.shift = [r[1] for r in rows]
        self.size = np.array([r[2] for r in rows], np.int64)
        self.whole = np.array([r[3] == 1 for r in rows], bool)
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size

    def cuts(self, capacity: int, shards: int) -> list[tuple[int, bool]] | None:
        """The greedy cuts: (cell, whether it is divided) at which each further shard begins; None if too many."""
        at, found = 0, []
        total = int(self.end[-1]) if len(self.end) else 0
        while at + capacity < total:
            cell = int(np.searchsorted(self.end, at + capacity, "right"))
            begin = int(self.start[cell])
            if begin < at + capacity and not self.whole[cell]:
                begin = at + capacity
            if begin <= at or len(found) == shards - 1:
                return None
            found.append((cell, begin > int(self.start[cell])))
            at = begin
        return found

    def least_capacity(self, shards: int) -> int:
        low = -(-int(self.end[-1]) // shards)
        high = int(self.end[-1])
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards) is None:
                low = middle + 1
            else:
                high = middle
        return low


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(capacity, hashes at which a shard begins) for groups (key, total), exactly."""

    def read(rows: DataFrame, shift: int) -> list[tuple[int, int, int, int]]:
        cell = F.shiftleft(F.shiftright("key", shift), shift).alias("low")
        found = rows.groupBy(cell).agg(F.sum("total").alias("size"), F.count("*").alias("n")).collect()
        return [(r[0], shift, r[1], r[2]) for r in found]

    rows = read(groups, _TOP)
    if not rows or shards == 1:
        return sum(r[2] for r in rows), []
    while True:
        cells = Cells(rows)
        capacity = cells.least_capacity(shards)
        found = cells.cuts(capacity, shards)
        divided = [cell for cell, inside in found if inside]
        if not divided:
            return capacity, [cells.low[cell] for cell, _ in found]
        near = {k for cell in divided for k in range(max(0, cell - _AROUND), min(len(rows), cell + _AROUND + 1)) if not cells.whole[k]}
        again = {(cells.low[k], cells.shift[k]) for k in near}
        rows = [r for r in rows if (r[0], r[1]) not in again]
        for shift in sorted({s for _, s in again}):
            low = [a for a, s in again if s == shift]
            inside = groups.filter(F.shiftleft(F.shiftright("key", shift), shift).isin(low))
            rows += read(inside, max(0, shift - _STEP))


def shard_plan(groups: DataFrame, shards: int = SHARDS) -> tuple[list[int], list[int]]:
    """(hashes of the groups with a shard of their own, hashes at which the other shards begin)."""
    total = groups.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    alone, left = [], shards
    for key, size in groups.orderBy(F.desc("total"), "key").limit(shards).collect():
        if left == 1 or size * left < total:
            break
        alone.append(key)
        total, left = total - size, left - 1
    rest = groups.filter(~F.col("key").isin(alone)) if alone else groups
    return alone, minimax_cuts(rest, left)[1]


def shard_of(key: Column, alone: list[int], cuts: list[int]) -> Column:
    """Groups of their own come last, from the highest number down."""
    number = F.lit(0)
    for at in cuts:
        number = number + (key >= at).cast("int")
    for k, group in enumerate(alone):
        number = F.when(key == group, F.lit(-1 - k)).otherwise(number)
    return number


def with_slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with slot: its place in its shard, from 0 without gaps, in the given order."""
    spread = rows.repartitionByRange("shard", *order).sortWithinPartitions("shard", *order)
    placed = cut(spread.withColumn("_at", F.monotonically_increasing_id()), "placed")
    task = F.shiftright("_at", 33)
    counts = placed.groupBy("shard", task.alias("_task")).agg(F.min("_at").alias("_first"), F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_task", "_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    # One row per task and shard that meet: at most the number of tasks and shards together.
    found = placed.withColumn("_task", task).join(F.broadcast(offsets), ["shard", "_task"])
    return found.withColumn("slot", F.col("_offset") + F.col("_at") - F.col("_first")).drop("_task", "_first", "_offset", "_at")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row: law ``bytes``.

    Null and empty texts are one group of size 1 a row and CRC 0. Rows that repeat an id, a
    null one too, have slots of their own. Other columns are ignored, whatever their names;
    an empty table gives no rows, and a shard may stay empty where groups are few.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("key"))
    sized = cut(sized, "sized")
    groups = cut(sized.groupBy("key").agg(F.sum("size").alias("total")), "groups")
    alone, cuts = shard_plan(groups, shards)
    number = shard_of(F.col("key"), alone, cuts)
    rows = sized.withColumn("shard", F.when(number < 0, number + shards).otherwise(number).cast("int"))
    return with_slots(rows, ["key", "id"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
