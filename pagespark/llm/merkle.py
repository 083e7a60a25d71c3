"""Merkle manifest of a dataset: a digest per row, a tree per source, a tree over the sources.

Every three neighbouring nodes of a level have one parent, the digest of their hex digests laid end
to end. While a parent is hashed, the hash state before each child slot is copied and kept; to fold a
replaced child the matching state is resumed with the replacement and the siblings right of it, so
what lies left is not hashed again.

Trees are built by blocks of 3**5 neighbouring nodes, five levels in one task: rows are numbered in
their source without gathering it, a block is one group of at most 243 digests, and the blocks' own
roots are the next step's nodes. A source of any size, also one that holds most rows, is many blocks.
On the way down each block learns the siblings above it, so proofs and folds need no other rows.

Defined results: null fields hash as ``-``; a null source is a source of its own, before the others;
rows of a source ascend by doc_id (null first), rows that share it by leaf and replacement; a lone
leaf is its source's root, a lone source's root the whole's; an empty table gives no rows. Columns
other than the fields are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagespark.operators.order import numbered, numbered_in
from pagespark.session import written

ARITY = 3
STEP = 5  # levels of a block
BLOCK = ARITY ** STEP
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

SIBLINGS = "array<struct<left: string, right: string>>"  # of the runs from a node up, digests laid end to end
LEAF_DDL = ("key string, doc_id bigint, leaf string, changed string, proof array<string>, folded_root string, "
            "root string, subroot string")


def _sha(text: bytes) -> "hashlib._Hash":
    return hashlib.sha256(text)


class Parent:
    """A hashed run of nodes with the states before each of its slots."""

    def __init__(self, children: Sequence[bytes]):
        self.children = children
        self.states = []
        state = _sha(b"")
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def fold(self, slot: int, replacement: bytes) -> bytes:
        """The parent's digest with another child in a slot."""
        state = self.states[slot].copy()
        state.update(replacement)
        state.update(b"".join(self.children[slot + 1:]))
        return state.hexdigest().encode()

    def sides(self, slot: int) -> tuple[bytes, bytes]:
        return b"".join(self.children[:slot]), b"".join(self.children[slot + 1:])


class Above:
    """The run above a whole block, of which only the siblings are known; the state before its slot is kept."""

    def __init__(self, left: str, right: str):
        self.left, self.right = left.encode(), right.encode()
        self.state = _sha(self.left)

    def fold(self, replacement: bytes) -> bytes:
        state = self.state.copy()
        state.update(replacement)
        state.update(self.right)
        return state.hexdigest().encode()


def grown(nodes: list[bytes], levels: int) -> list[list[Parent]]:
    """The parents of each level above the nodes, ``levels`` times or until none is left to add."""
    out = []
    for _ in range(levels):
        row = [Parent(nodes[i:i + ARITY]) for i in range(0, len(nodes), ARITY)]
        out.append(row)
        nodes = [p.digest for p in row]
    return out


def levels_of(count: Column) -> Column:
    """Levels above the leaves: the powers of the arity below the count."""
    powers = [ARITY ** k for k in range(40) if ARITY ** k < 1 << 62]
    return F.size(F.filter(F.array(*[F.lit(p) for p in powers]), lambda p: p < count))


def _blocks(nodes: DataFrame, *more: str) -> DataFrame:
    """Groups of neighbouring nodes as arrays by place; at most BLOCK each."""
    return nodes.groupBy("key", F.floor(F.col("at") / BLOCK).cast("bigint").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("at", "digest", *more))).alias("nodes"), F.max("levels").alias("levels"))


def _roots(blocks: DataFrame) -> DataFrame:
    """key, at, digest, levels: the root of each block as a node of the next step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers, digests, levels = (batch.column(i) for i in range(4))
            tops, left = [], []
            for own, n in zip(digests, levels.to_pylist()):
                here = [x.encode() for x in own.as_py()]
                rows = grown(here, min(n, STEP))
                tops.append((rows[-1][0].digest if rows else here[0]).decode())
                left.append(max(n - STEP, 0))
            yield pa.RecordBatch.from_arrays(
                [keys, numbers, pa.array(tops, pa.string()), pa.array(left, pa.int32())], names=["key", "at", "digest", "levels"])

    return blocks.select("key", "block", "nodes.digest", F.col("levels").cast("int")).mapInArrow(
        run, "key string, at bigint, digest string, levels int")


def _paths(blocks: DataFrame) -> DataFrame:
    """key, at, siblings: for each node its runs inside its block and then those above the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, places, digests, n, above in zip(*(c.to_pylist() for c in batch.columns)):
                rows = grown([d.encode() for d in digests], min(n, STEP))
                paths = []
                for i in range(len(digests)):
                    own = [rows[k][i // ARITY ** (k + 1)].sides(i // ARITY ** k % ARITY) for k in range(len(rows))]
                    paths.append([{"left": x.decode(), "right": y.decode()} for x, y in own] + above)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(places), pa.string()), pa.array(places, pa.int64()),
                     pa.array(paths, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))],
                    names=["key", "at", "siblings"])

    return blocks.select("key", "nodes.at", "nodes.digest", F.col("levels").cast("int"), "siblings").mapInArrow(
        run, f"key string, at bigint, siblings {SIBLINGS}")


def _climb(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, digest of the tree's root), (key, at, siblings above each block) for blocks of one forest."""
    tops = written(_roots(blocks), "tops")
    most = tops.agg(F.max("levels")).first()[0]
    if not most:
        return tops.select("key", "digest"), tops.select("key", "at", F.array().cast(SIBLINGS).alias("siblings"))
    upper = written(_blocks(tops), "blocks")
    roots, above = _climb(upper)
    return roots, _paths(_under(upper, above))


def _under(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Blocks with the siblings above them."""
    return blocks.join(above.withColumnRenamed("at", "block"), ["key", "block"])


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 bytes of the value after their number and a colon."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def manifest(docs: DataFrame, replaced: Column | None = None, changed_text: Column | None = None,
             group: str = "source", order: str = "doc_id", fields: Sequence[str] = FIELDS, text: str = "text") -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof (siblings from the leaf to the root, left to right),
    changed (the leaf with ``changed_text`` in place of the text where ``replaced`` holds, else the
    leaf), folded_root (``changed`` folded through the original siblings) and verified (it equals root)."""
    columns = [F.col(c) for c in fields]
    leaf = leaf_of(columns)
    if replaced is None or changed_text is None:
        changed = leaf
    else:
        other = leaf_of([changed_text if c == text else F.col(c) for c in fields])
        changed = F.when(replaced, other).otherwise(leaf)
    key = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))  # null comes first
    leaves = docs.select(key.alias("key"), F.col(order).cast("bigint").alias("doc_id"), leaf.alias("digest"), changed.alias("changed"))
    placed = numbered_in(leaves, ["key"], ["doc_id", "digest", "changed"], "at")
    counts = placed.groupBy("key").agg(F.count("*").alias("_n"))
    sized = placed.join(counts, "key").withColumn("levels", levels_of(F.col("_n")))
    blocks = written(_blocks(sized, "doc_id", "changed"), "blocks")
    subroots, above = _climb(blocks)
    subroots = written(subroots, "subroots")

    sources = numbered(subroots, ["key"], "at").select(F.lit("").alias("key"), "at", "digest", F.col("key").alias("source"))
    whole = F.lit(sources.count())
    top_blocks = written(_blocks(sources.withColumn("levels", levels_of(whole)), "source"), "blocks")
    root, over = _climb(top_blocks)
    routes = _paths(_under(top_blocks, over)).join(sources, ["key", "at"]).select(
        F.col("source").alias("key"), F.col("digest").alias("subroot"), F.col("siblings").alias("upper"))
    routes = routes.withColumn("root", root.select("digest").scalar())

    known = _under(blocks, above).join(written(routes, "routes"), "key")
    return _folded(known).select(
        "doc_id", "leaf", "subroot", "root", "proof", "changed", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _folded(blocks: DataFrame) -> DataFrame:
    """The rows of each block with proof and folded root."""
    names = [c.split()[0].rstrip(":") for c in LEAF_DDL.split(", ")]

    def rows_of(key, ids, digests, changed, n, inner, upper, subroot, root):
        leaves = [d.encode() for d in digests]
        rows = grown(leaves, min(n, STEP))
        above = [Above(s["left"], s["right"]) for s in [*inner, *upper]]
        rest = [s for a in above for s in _split(a.left) + _split(a.right)]
        for i, other in enumerate(changed):
            proof: list[str] = []
            now = other.encode()
            for k, row in enumerate(rows):
                parent, slot = row[i // ARITY ** (k + 1)], i // ARITY ** k % ARITY
                left, right = parent.sides(slot)
                proof += _split(left) + _split(right)
                now = parent.fold(slot, now)
            for run in above:
                now = run.fold(now)
            yield key, ids[i], digests[i], other, proof + rest, now.decode(), root, subroot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), *[pa.string()] * 3]
        for batch in batches:
            for k in range(batch.num_rows):  # a block at a time bounds what is held
                found = list(rows_of(*[c[k].as_py() for c in batch.columns]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=kind) for c, kind in zip(zip(*found), kinds)], names=names)

    return blocks.select("key", "nodes.doc_id", "nodes.digest", "nodes.changed", F.col("levels").cast("int"),
                         "siblings", "upper", "subroot", "root").mapInArrow(run, LEAF_DDL)


def _split(digests: bytes) -> list[str]:
    text = digests.decode()
    return [text[i:i + 64] for i in range(0, len(text), 64)]
