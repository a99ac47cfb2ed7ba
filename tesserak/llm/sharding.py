"""Shards of nearly equal bytes that keep equal texts together.

Groups of equal texts are atoms, ordered by their text's SHA-256.  The smallest
capacity with which that order can be cut into the wanted number of runs is found
by binary search, and each capacity is checked greedily.

The search never sees single groups in bulk: it works on sums over prefixes of the
digest and refines only the prefixes where a cut may fall, sixteen ways at a time,
until the bounds of the capacity meet.  What it reads is bounded by the number of
shards, whatever the size of the corpus.  Only DataFrame functions touch the rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, numbered

#: Digits of the digest that the first sums are over, and the digit after all others.
FIRST, BEYOND = 3, "g"


@dataclass(frozen=True)
class Block:
    """Groups whose digests begin with ``prefix``: their bytes and their number."""

    prefix: str
    size: int
    groups: int


def _least(low: int, high: int, fits: Callable[[int], bool]) -> int:
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


class Order:
    """Blocks in the order of their prefixes, and greedy cuts through them."""

    def __init__(self, blocks: list[Block]):
        self.blocks = sorted(blocks, key=lambda b: b.prefix)
        self.ends = list(accumulate((b.size for b in self.blocks), initial=0))
        self.total = self.ends[-1]

    def whole(self, start: int, capacity: int) -> int:
        """The farthest end of a shard from ``start`` if no block may be divided."""
        return self.ends[bisect_right(self.ends, start + capacity) - 1]

    def liquid(self, start: int, capacity: int) -> int:
        """The same if a block of several groups may be cut at any byte: a bound."""
        end = min(start + capacity, self.total)
        i = bisect_right(self.ends, end) - 1
        return end if i == len(self.blocks) or self.blocks[i].groups > 1 else self.ends[i]

    def fits(self, reach: Callable[[int, int], int], shards: int, capacity: int) -> bool:
        at = 0
        for _ in range(shards):
            at = reach(at, capacity)
        return at >= self.total

    def bounds(self, shards: int) -> tuple[int, int]:
        """The least and the greatest value that the smallest capacity may have."""
        low = max([-(-self.total // shards), *(b.size for b in self.blocks if b.groups == 1)])
        least = _least(low, self.total, lambda c: self.fits(self.liquid, shards, c))
        return least, _least(least, self.total, lambda c: self.fits(self.whole, shards, c))

    def open_blocks(self, shards: int, least: int, most: int) -> list[Block]:
        """The blocks of several groups in which a cut may fall."""
        out, low, high = set(), 0, 0
        for _ in range(shards - 1):
            low, high = self.whole(low, least), self.liquid(high, most)
            for i in range(max(bisect_right(self.ends, low) - 1, 0), min(bisect_left(self.ends, high), len(self.blocks))):
                if self.blocks[i].groups > 1:
                    out.add(self.blocks[i])
        return sorted(out, key=lambda b: b.prefix)

    def cuts(self, shards: int, capacity: int) -> list[str]:
        """The prefix with which each shard but the first begins.

        No shard is above ``capacity``; within that, ends lie as near to equal shares
        of what is left as they can.
        """
        last = [self.total]  # the least end of each shard, from the right
        for _ in range(shards - 1):
            last.append(self.ends[bisect_left(self.ends, max(last[-1] - capacity, 0))])
        out, at = [], 0
        for left in range(shards, 1, -1):
            far, aim = self.whole(at, capacity), at + (self.total - at) / left
            i = bisect_left(self.ends, aim)
            near = min(self.ends[max(i - 1, 0) : i + 1], key=lambda e: abs(e - aim))
            at = min(max(near, last[left - 1], at), far)
            i = bisect_left(self.ends, at)
            out.append(self.blocks[i].prefix if i < len(self.blocks) else BEYOND)
        return out


def _summed(groups: DataFrame, digits: int) -> list[Block]:
    """The blocks of so many digits: at most 16 for each that the groups were held to."""
    sums = groups.groupBy(F.substring("digest", 1, digits).alias("prefix")).agg(F.sum("held").alias("size"), F.count("*").alias("n"))
    return [Block(r.prefix, r["size"], r.n) for r in sums.collect()]


@dataclass(frozen=True)
class Plan:
    """Digests that fill a shard of their own, and where the other shards begin."""

    alone: list[str]
    begins: list[str]
    capacity: int

    def shard(self, digest: Column) -> Column:
        every = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
        before = F.size(F.filter(every(self.begins), lambda b: digest >= b))
        own = F.array_position(every(self.alone), digest)
        return F.when(own > 0, own - 1).otherwise(len(self.alone) + before).cast("int")


def plan(groups: DataFrame, shards: int) -> Plan:
    """Cut rows (digest, held), one a group, into ``shards`` runs.

    A group above the mean of what is left is a run by itself and stands before the
    others; at most ``shards`` groups can be such.
    """
    total = groups.agg(F.sum("held")).first()[0] or 0
    alone, heaviest, left = [], 0, total
    for r in groups.orderBy(F.desc("held"), "digest").limit(shards - 1).collect():
        if len(alone) == shards - 1 or r.held * (shards - len(alone)) <= left:
            break
        alone.append(r.digest)
        heaviest, left = max(heaviest, r.held), left - r.held
    wanted = shards - len(alone)
    rest = groups.where(~F.col("digest").isin(alone)) if alone else groups
    digits, order = FIRST, Order(_summed(rest, FIRST))
    while True:
        least, most = order.bounds(wanted)
        if least == most:
            return Plan(alone, order.cuts(wanted, most), max(most, heaviest))
        # bounds only get closer, so what is open lies in what was open before
        gone = {b.prefix for b in order.open_blocks(wanted, least, most)}
        rest = cut(rest.where(F.substring("digest", 1, digits).isin(sorted(gone))), "open")
        digits += 1
        order = Order([b for b in order.blocks if b.prefix not in gone] + _summed(rest, digits))


def by_bytes(docs: DataFrame, shards: int = 24, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row.

    ``size`` is the text's UTF-8 bytes and 8 more.  Rows of equal texts share a shard;
    shards hold nearly equal bytes.  ``slot`` numbers a shard's rows from 0, by digest
    and doc_id (nulls first).  A null text is an empty one: size 8, CRC 0.  Repeated
    rows get a slot each; a null key stays null; other columns are dropped, whatever
    their names; no rows give none.  Fewer texts than shards leave shards empty.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(value) + F.lit(8)).cast("long").alias("size"), F.crc32(value.cast("binary")).alias("text_crc32"), F.sha2(value, 256).alias("digest"))
    rows = cut(rows, "rows")
    groups = cut(rows.groupBy("digest").agg(F.sum("size").alias("held")), "groups")
    placed = rows.withColumn("shard", plan(groups, shards).shard(F.col("digest")))
    out = numbered(placed, "shard", ["digest", "doc_id"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
