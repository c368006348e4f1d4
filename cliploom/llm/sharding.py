"""Sharding by a hierarchical weighted hash tree.

The fleet is a tree: regions hold racks, racks hold shards; a node weighs as much as the shards below it. A document
descends region, rack and shard: at each level every child draws -ln(u) / weight, u being a hash of doc_id and the
child's own name, and the smallest draw wins. A child's draw depends on nothing but its name and weight, so a changed
weight moves rows only into or out of the subtree in which it changed: `Fleet.weights` gives shards weights other than 1,
a region or rack weighs what its shards weigh, and a shard of weight 0 gets no rows. Shards beyond the fleet that was laid out first
each open a region of their own, so one more shard takes rows only into itself and moves none between the others.

This is the law `key`: doc_id and the number of shards alone decide, whatever the text; equal texts with different
ids are separate rows. Slots are gapless in a shard: rows of a shard are dealt to buckets by hash, a bucket's first
slot is the number of rows in the buckets before it, and only rows of one bucket are ranked together.

Null texts have no bytes and the checksum of an empty text. Rows with a null doc_id all draw alike, and so do rows that
repeat an id: they share a shard and a bucket. Repeated rows get slots of their own. A very long text only has its bytes
counted. Equal draws of two children (of 64-bit hashes) go to the first. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width


@dataclass(frozen=True)
class Fleet:
    """regions x racks x shards that were laid out first; later shards stand alone in regions of their own. weights: pairs of
    shard and weight (0 or more) of those that do not weigh 1."""

    regions: int = 4
    racks: int = 2
    shards: int = 5
    weights: tuple[tuple[int, float], ...] = ()

    def weight(self, shards: list[int]) -> float:
        """Weight of a node, from the shards below it."""
        told = dict(self.weights)
        return float(sum(told.get(s, 1.0) for s in shards))

    def tree(self, n_shards: int) -> list[list[list[int]]]:
        laid = self.regions * self.racks * self.shards
        base = [
            [
                [s for s in range((g * self.racks + r) * self.shards, (g * self.racks + r + 1) * self.shards) if s < n_shards]
                for r in range(self.racks)
            ]
            for g in range(self.regions)
        ]
        base += [[[s]] for s in range(laid, n_shards)]
        base = [[[s for s in rack if self.weight([s]) > 0] for rack in region] for region in base]
        base = [[rack for rack in region if rack] for region in base]
        if not (base := [region for region in base if region]):
            raise ValueError("no shard has a weight")
        return base


def draw(key: Column, name: str, weight: float) -> Column:
    """Exponential draw of one child: 53 bits of a hash become u in (0, 1)."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(weight))


def descend(key: Column, fleet: Fleet, n_shards: int) -> Column:
    """Shard of a key. A level's node is chosen first, then only the draws of that node's children are made."""

    def pick(children: list[tuple[str, float, Column]]) -> Column:
        if len(children) == 1:
            return children[0][2]
        draws = F.array(*[draw(key, name, weight) for name, weight, _ in children])
        chosen = F.array_position(draws, F.array_min(draws))
        return F.transform(
            F.array(chosen),
            lambda at: _case(at, [value for _, _, value in children]),
        )[0]

    def _case(at: Column, values: list[Column]) -> Column:
        out = F.when(at == 1, values[0])
        for i, value in enumerate(values[1:], 2):
            out = out.when(at == i, value)
        return out

    # Names hold the place of a node in the fleet: they do not change when shards or weights change elsewhere.
    def name(kind: str, shard: int) -> str:
        laid, span = fleet.regions * fleet.racks * fleet.shards, {"region": fleet.racks * fleet.shards, "rack": fleet.shards}[kind]
        return f"{kind}/{shard // span * span if shard < laid else shard}"

    regions = []
    for region in fleet.tree(n_shards):
        racks = []
        for rack in region:
            shards = [(f"shard/{s}", fleet.weight([s]), F.lit(s)) for s in rack]
            racks.append((name("rack", rack[0]), fleet.weight(rack), pick(shards)))
        regions.append((name("region", region[0][0]), fleet.weight([s for rack in region for s in rack]), pick(racks)))
    return pick(regions)


def shard_documents(docs: DataFrame, n_shards: int, *, fleet: Fleet = Fleet(), buckets: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (the shard when there is one more)."""
    buckets = buckets or max(64, shuffle_width(docs.sparkSession))
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.col("doc_id")
    place = {
        "shard": descend(key, fleet, n_shards).cast("int"),
        "bucket": F.pmod(F.xxhash64(key, F.lit("bucket")), F.lit(buckets)),
    }
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        descend(key, fleet, n_shards + 1).cast("int").alias("grown_shard"),
        *[column.alias(name) for name, column in place.items()],
    )
    counts = docs.select(*[column.alias(name) for name, column in place.items()]).groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most n_shards * buckets rows, whatever the input.
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("nth", F.row_number().over(within))
        .join(F.broadcast(starts), ["shard", "bucket"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"),
            "grown_shard",
        )
    )
