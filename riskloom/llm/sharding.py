"""Sharding by best-fit-decreasing bin packing of indivisible groups.

A group is all documents with the same text; it is never split. Groups sorted by size enter
the bin whose remaining capacity is the tightest that still holds them, found in a balanced
tree of (remaining, bin). A group that fits nowhere enters the emptiest bin.

A group above an equal share of all bytes has a bin to itself, and the other bins share what
is left. Groups above ``1 / (shards * HEAVY)`` of all bytes are fewer than ``shards * HEAVY``; they are
packed first, in one task of that proven size. The rest is dealt by hash into cells of about
``CELL`` groups. Every cell packs its groups into its share of what the bins have left, in
parallel. A cell is off by at most one of its groups, each below the bound above.

Defined cases: a null text is an empty one; size is the text's bytes plus 1; repeated rows
are members of their group; the order of equal sizes is that of the text's digest; an empty
table gives an empty result; other columns are ignored. With ``capacity``, the number of
shards is the least from total / capacity up (steps of one percent) at which no shard
exceeds it; a group larger than the capacity is allowed to.
"""

from __future__ import annotations

import math
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import ranked, staged

HEAVY = 4096
CELL = 20_000


class Bins:
    """A treap of (remaining, bin): a balanced search tree for the tightest fit."""

    def __init__(self, remaining: list[int]):
        self.root = None
        for b, free in enumerate(remaining):
            self.add(free, b)

    def add(self, free: int, b: int) -> None:
        key = (free, b)
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, [key, crc32(b"%d %d" % key), None, None]), high)

    def take(self, need: int) -> tuple[int, int]:
        """Removes and returns the tightest bin with ``need`` left, else the emptiest."""
        low, high = self._split(self.root, (need, -1))
        node = high
        if node is not None:
            while node[2] is not None:
                node = node[2]
        else:
            node = low
            while node[3] is not None:
                node = node[3]
        key = node[0]
        low, rest = self._split(self.root, key)
        _, high = self._split(rest, (key[0], key[1] + 1))
        self.root = self._merge(low, high)
        return key

    def _split(self, node, key):
        """Nodes below the key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            a, b = self._split(node[3], key)
            return [node[0], node[1], node[2], a], b
        a, b = self._split(node[2], key)
        return a, [node[0], node[1], b, node[3]]

    def _merge(self, a, b):
        if a is None or b is None:
            return a if b is None else b
        if a[1] > b[1]:
            return [a[0], a[1], a[2], self._merge(a[3], b)]
        return [b[0], b[1], self._merge(a, b[2]), b[3]]


def best_fit_decreasing(weights: list[int], remaining: list[int]) -> list[int]:
    """The bin of each weight; weights come in falling order."""
    bins, out = Bins(remaining), []
    for w in weights:
        free, b = bins.take(w)
        bins.add(free - w, b)
        out.append(b)
    return out


def capacities(largest: list[int], total: int, shards: int) -> list[int]:
    """Equal capacities, but for groups above an equal share: each has a bin of its own size, and the others share the rest.

    ``largest`` has the largest weights, in falling order, as many as there are shards.
    """
    own: list[int] = []
    for w in largest:
        if len(own) + 1 >= shards or w * (shards - len(own)) <= total - sum(own):
            break
        own.append(w)
    return own + [max(1, -(-(total - sum(own)) // (shards - len(own))))] * (shards - len(own))


def sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )


def pack_groups(groups: DataFrame, shards: int, capacity: int | None = None) -> DataFrame:
    """digest, weight, shard for each of the groups (digest, weight)."""
    total, n = groups.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.count("*")).first()
    if capacity is None:
        largest = [r[0] for r in groups.select("weight").orderBy(F.desc("weight")).limit(shards).collect()]
        bins = capacities(largest, total, shards)
    else:
        bins = [capacity] * shards
    heavy = F.col("weight") * (shards * HEAVY) > total
    out = "digest binary, weight bigint, shard int"

    def packer(spaces):
        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["weight", "digest"], ascending=[False, True])
            weights = pdf["weight"].tolist()
            pdf["shard"] = best_fit_decreasing(weights, spaces(sum(weights)))
            return pdf[["digest", "weight", "shard"]]

        return pack

    large = staged(
        groups.where(heavy).select("digest", "weight", F.lit(0).alias("cell")).groupBy("cell").applyInPandas(packer(lambda _: list(bins)), out),
        "packed-heavy",
    )
    used = dict(large.groupBy("shard").agg(F.sum("weight")).collect())
    left = [max(0, space - used.get(b, 0)) for b, space in enumerate(bins)]
    room = max(1, sum(left))
    # each cell gets as much of every bin's room as it has of the remaining bytes
    cells = max(1, math.ceil(n / CELL))
    small = groups.where(~heavy).select("digest", "weight", F.pmod(F.xxhash64("digest"), F.lit(cells)).alias("cell"))
    light = small.groupBy("cell").applyInPandas(packer(lambda mine: [x * mine // room for x in left]), out)
    return staged(large.unionByName(light), "packed")


def shard_documents(docs: DataFrame, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, digest, shard, slot (from 0, gapless)."""
    rows = staged(sized(docs), "sized")
    groups = staged(rows.groupBy("digest").agg(F.sum("size").alias("weight")), "text-groups")
    if shards is not None:
        packed = pack_groups(groups, shards)
    else:
        total, largest = groups.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.max("weight"), F.lit(0))).first()
        count = max(1, -(-total // capacity))
        while True:
            packed = pack_groups(groups, count, capacity)
            fullest = packed.groupBy("shard").agg(F.sum("weight").alias("w")).agg(F.max("w")).first()[0] or 0
            if fullest <= max(capacity, largest):
                break
            count += max(1, count // 100)
    a, b = rows.alias("a"), packed.alias("b")
    placed = a.join(b, F.col("a.digest") == F.col("b.digest")).select("a.*", "b.shard")
    order = ranked(placed, [F.col("shard"), F.col("digest"), F.col("doc_id")], "shard-order")
    first = order.groupBy("shard").agg(F.min("_rank").alias("first"))
    o, f = order.alias("o"), first.alias("f")
    return o.join(f, F.col("o.shard") == F.col("f.shard")).select(
        "o.doc_id", "o.size", "o.text_crc32", "o.digest", "o.shard", (F.col("o._rank") - F.col("f.first")).alias("slot")
    )
