"""Sharding by a weighted hash tree: a document descends region, rack and shard.

At each node every child draws ``-ln(u) / weight`` with u hashed from the document's key and
the child's path; the smallest draw wins, so a child wins in proportion to its weight. A
changed weight changes one child's draws at each level of its own path: documents move only
into or out of subtrees whose weights changed. A new shard gets a region of its own, so it
takes documents into itself and moves none between the old ones.

Only column expressions are used. Defined results: a null text has no bytes (size 1, crc 0);
a null key is drawn like any other key; rows that share a key share a shard and get slots of
their own; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagespark.operators.order import numbered_in


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


BASE_SHARDS, RACKS, PER_RACK = 8, 2, 2


def tree_of(shards: int) -> list[Leaf]:
    """Shards 0 to 7 in two regions of two racks of two; each later shard in a region of its own.
    A tree of fewer than eight shards keeps the paths of those it has."""
    out = []
    for s in range(shards):
        if s < BASE_SHARDS:
            rack = s // PER_RACK
            out.append(Leaf(f"region{rack // RACKS}", f"rack{rack}", s))
        else:
            out.append(Leaf(f"region-of-{s}", f"rack-of-{s}", s))
    return out


def _drawn(key: Column, children: Sequence[tuple[str, float]], seed: int) -> Column:
    """Place in the list of the child whose draw is smallest."""
    draws = []
    for i, (path, weight) in enumerate(children):
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(path), key), 11)
        u = (bits.cast("double") + 0.5) / F.lit(float(1 << 53))
        draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("t"), F.lit(i).alias("i")))
    return F.array_min(F.array(*draws))["i"] if len(draws) > 1 else F.lit(0)


def shard_of(key: Column, leaves: Sequence[Leaf], seed: int = 0) -> Column:
    """The shard a key descends to; leaves of weight 0 take nothing."""
    live = [x for x in leaves if x.weight > 0]
    if not live:
        raise ValueError("no shard has a weight")

    def level(rows: Sequence[Leaf], path: str, names: Sequence[str]) -> Column:
        if not names:
            return F.lit(rows[0].shard)
        groups: dict[str, list[Leaf]] = {}
        for x in rows:
            groups.setdefault(str(getattr(x, names[0])), []).append(x)
        children = [(f"{path}/{name}", sum(x.weight for x in own)) for name, own in groups.items()]
        below = [level(own, child, names[1:]) for (child, _), own in zip(children, groups.values())]
        drawn = _drawn(key, children, seed)
        out = below[-1]
        for i in range(len(below) - 2, -1, -1):
            out = F.when(drawn == i, below[i]).otherwise(out)
        return out

    return level(live, "", ("region", "rack", "shard")).cast("int")


def shard_documents(docs: DataFrame, shards: int = 8, leaves: Sequence[Leaf] | None = None,
                    grown: Sequence[Leaf] | None = None, seed: int = 0) -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard, grown_shard (with one more shard) and a slot,
    gapless from 0 in each shard in order of doc_id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    placed = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("bigint").alias("text_crc32"),
        shard_of(F.col("doc_id"), leaves or tree_of(shards), seed).alias("shard"),
        shard_of(F.col("doc_id"), grown or tree_of(shards + 1), seed).alias("grown_shard"),
    )
    return numbered_in(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
