"""Merkle manifest of a dataset: aligned subtrees in van Emde Boas order, block roots as leaves of the next round."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import numbered
from tapeloom.session import materialize

#: A block is a subtree of up to 2^HEIGHT leaves, one row of the manifest. Trees of any size are blocks over block roots.
HEIGHT = 8
#: A step of a path: side of the sibling, then its digest.
STEP = 33
RIGHT, LEFT, NONE = 0, 1, 2


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of nodes (``depth`` from the root, ``index`` in their level) of a tree of ``levels`` levels.

    The tree is cut at half its height; the top part comes first, then the bottom trees from left to right, each
    stored by the same rule. A path of any length so stays inside few runs of memory, whatever their size.
    """
    base = np.zeros(len(index), np.int64)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        depth, levels = depth - top, levels - top
        base += ((1 << top) - 1) + (index >> depth) * ((1 << levels) - 1)
        index = index & ((1 << depth) - 1)
    return base


def _levels(n: int, leaves: int) -> int:
    """Levels of a block with ``leaves`` leaves in a tree of ``n``: full height if others stand beside it."""
    return HEIGHT + 1 if n > 1 << HEIGHT else max(leaves - 1, 0).bit_length() + 1


def grow(digests: np.ndarray, levels: int) -> np.ndarray:
    """The stored subtree (nodes, 32) over ``digests`` (leaves, 32). A node without a partner is hashed alone."""
    tree = np.zeros(((1 << levels) - 1, 32), np.uint8)
    row = [d.tobytes() for d in digests]
    for depth in range(levels - 1, -1, -1):
        tree[address(levels, depth, np.arange(len(row)))] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, 32)
        names = [d.hex() for d in row]
        row = [sha256("".join(names[i : i + 2]).encode()).digest() for i in range(0, len(names), 2)]
    return tree


def paths(tree: np.ndarray, leaves: int) -> np.ndarray:
    """(leaves, steps, STEP): siblings of every leaf from the bottom of a stored subtree to its root."""
    levels = (len(tree) + 1).bit_length() - 1
    out, index, count = np.zeros((leaves, levels - 1, STEP), np.uint8), np.arange(leaves), leaves
    for step in range(levels - 1):
        beside = index ^ 1
        there = beside < count
        out[:, step, 0] = np.where(there, index & 1, NONE)
        out[there, step, 1:] = tree[address(levels, levels - 1 - step, beside[there])]
        index, count = index >> 1, (count + 1) >> 1
    return out


def fold(leaf: bytes, path: bytes) -> tuple[str, str]:
    """(hash of the siblings, root) as hex, for a leaf and its path."""
    node, beside = leaf.hex(), []
    for i in range(0, len(path), STEP):
        side, other = path[i], path[i + 1 : i + STEP].hex()
        if side == NONE:
            node = sha256(node.encode()).hexdigest()
            continue
        beside.append(other)
        node = sha256((other + node if side == LEFT else node + other).encode()).hexdigest()
    return sha256("".join(beside).encode()).hexdigest(), node


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields: ``-`` for null, else count of UTF-8 bytes, ``:`` and the value."""
    text = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)) for x in text]), 256))


@dataclass
class Manifest:
    """Written tables. ``leaves``: blocks of every group, lowest round first; ``tops``: blocks over the groups' roots."""

    leaves: list[DataFrame]
    tops: list[DataFrame]
    subroots: DataFrame

    def root(self) -> DataFrame:
        """One row (none for an empty table): root, hex."""
        return self.tops[-1].select(F.lower(F.hex("root")).alias("root"))


def _grower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, trees, roots = batch.schema.get_field_index("digests"), [], []
        for n, row in zip(batch.column("n").to_pylist(), batch.column(at)):
            digests = np.frombuffer(b"".join(row.as_py()), np.uint8).reshape(-1, 32)
            tree = grow(digests, _levels(n, len(digests)))
            trees.append(tree.tobytes())
            roots.append(tree[0].tobytes())
        columns = [*[c for i, c in enumerate(batch.columns) if i != at], pa.array(trees, pa.binary()), pa.array(roots, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=[*[x for x in batch.schema.names if x != "digests"], "tree", "root"])


def _rounds(nodes: DataFrame, most: int, carried: list[str]) -> list[DataFrame]:
    """Blocks (g, n, block, leaves, carried..., tree, root), round by round, until the largest group is one block."""
    found = []
    while True:
        members = F.sort_array(F.collect_list(F.struct("at", "digest", *carried)))
        blocks = nodes.groupBy("g", "n", F.shiftright("at", HEIGHT).alias("block")).agg(members.alias("x"))
        blocks = blocks.select("g", "n", "block", F.size("x").alias("leaves"), *[F.col(f"x.{c}").alias(c) for c in carried], F.col("x.digest").alias("digests"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema if f.name != "digests")
        blocks = materialize(blocks.mapInArrow(_grower, schema + ", tree binary, root binary"), "subtrees")
        found.append(blocks)
        if most <= 1 << HEIGHT:
            return found
        most, carried = -(-most >> HEIGHT), []
        full = blocks.where(F.col("n") > (1 << HEIGHT))
        nodes = full.select("g", F.ceil(F.col("n") / (1 << HEIGHT)).cast("long").alias("n"), F.col("block").alias("at"), F.col("root").alias("digest"))


def build(docs: DataFrame, fields: list[str], group: str = "lang", order: str = "doc_id", claimed: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``: a leaf per row over ``fields``, a tree per ``group``, a tree over the groups' roots.

    Leaves of a group ascend by ``order`` (null first, equal ones by digest); groups ascend bytewise, null first. While a
    tree has several nodes, every two neighbours become the hash of their digests in hex, a last single one the hash of its own; a
    lone leaf is its tree's root. Equal rows are leaves of their own. An empty table has no root.

    ``claimed`` names columns of ``fields`` as someone says they are; ``proofs`` then judges rows by these.

    Leaves are numbered by a range deal, cut into aligned blocks of 2^HEIGHT and grown block by block in the tasks; block
    roots are the nodes of the next round. A third of all rows in one group so spreads like any other rows, and rounds grow
    with the logarithm of the rows. Each table is written, so a lost executor loses no finished round.
    """
    now = [(claimed or {}).get(c, F.col(c)) for c in fields]
    changed = [c for c in fields if c in (claimed or {})]
    same = F.lit(True)
    for c in changed:
        same &= F.col(c).eqNullSafe(claimed[c])
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"), F.col(order).alias("id"), leaf_digest([F.col(c) for c in fields]).alias("digest"),
        F.when(~same, leaf_digest(now)).alias("claim"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "leaves")
    placed = materialize(numbered(rows, ["g"], ["id", "digest", "row"]).drop("row"), "numbered")
    most = placed.agg(F.max("n")).first()[0] or 0
    leaves = _rounds(placed, most, ["id", "claim"])
    subroots = [b.where(F.col("n") <= (1 << HEIGHT)).select("g", F.col("root").alias("digest")) for b in leaves]
    union = subroots[0]
    for s in subroots[1:]:
        union = union.unionByName(s)
    names = materialize(numbered(union, [], ["g"]).select(F.lit("").alias("g"), F.col("g").alias("name"), "at", "n", "digest"), "subroots")
    tops = _rounds(names.drop("name"), names.count(), [])
    return Manifest(leaves, tops, names)


def _walk(keep: list[str]):
    """Rows (g, block, leaves, tree, path, keep...) to a row per leaf: g, at, path, keep..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                found = paths(np.frombuffer(row["tree"], np.uint8).reshape(-1, 32), row["leaves"])
                m = len(found)
                path = [f.tobytes() + row["path"] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["g"]] * m), pa.array((row["block"] << HEIGHT) + np.arange(m)), pa.array(path, pa.binary()), *[pa.array([row[k]] * m, pa.binary()) for k in keep]],
                    names=["g", "at", "path", *keep])

    return run


def _down(blocks: list[DataFrame], start: DataFrame, keep: list[str]) -> DataFrame:
    """Paths of the lowest blocks: ``start`` (g, path, keep...) belongs to the one block that ends each tree."""
    ends = (b.where(F.col("n") <= (1 << HEIGHT)).select("g", "block").join(start, "g") for b in reversed(blocks))
    at = None
    for b, end in zip(reversed(blocks), ends):
        every = end if at is None else end.unionByName(at.withColumnRenamed("at", "block"))
        if b is blocks[0]:
            return every
        extra = "".join(f", {k} binary" for k in keep)
        at = b.join(every, ["g", "block"]).select("g", "block", "leaves", "tree", "path", *keep).mapInArrow(_walk(keep), f"g string, at long, path binary{extra}")
        at = materialize(at, "paths")


def proofs(manifest: Manifest) -> DataFrame:
    """One row per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root (hex), verified.

    ``proof_sha256`` is the hash of the siblings from the leaf up, left to right as they are met. ``folded_root`` is
    computed from the claimed leaf (else the leaf) and these siblings; ``verified`` says that it is the root.

    Paths go down the rounds: a block adds its own steps to the path of its root, one row per block.
    """
    spark = manifest.subroots.sparkSession
    start = spark.createDataFrame([("", bytearray())], "g string, path binary")
    top = manifest.tops[0].join(_down(manifest.tops, start, []), ["g", "block"]).select("g", "block", "leaves", "tree", "path")
    top = materialize(top.mapInArrow(_walk([]), "g string, at long, path binary"), "paths")
    groups = manifest.subroots.join(top.select("at", "path"), "at").select(F.col("name").alias("g"), "path", F.col("digest").alias("subroot"))
    lowest = manifest.leaves[0].join(_down(manifest.leaves, groups, ["subroot"]), ["g", "block"])
    lowest = lowest.select("leaves", "tree", "path", "subroot", "id", "claim")
    kind = manifest.leaves[0].schema["id"].dataType.elementType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.select(["leaves", "tree", "path", "subroot", "claim"])
            for i in range(batch.num_rows):
                row = named.slice(i, 1).to_pylist()[0]
                tree, m = np.frombuffer(row["tree"], np.uint8).reshape(-1, 32), row["leaves"]
                levels = (len(tree) + 1).bit_length() - 1
                own = tree[address(levels, levels - 1, np.arange(m))]
                out = []
                for leaf, claim, path in zip(own, row["claim"], paths(tree, m)):
                    out.append((leaf.tobytes().hex(), *fold(claim or leaf.tobytes(), path.tobytes() + row["path"])))
                leaf, proof, folded = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[i].values, pa.array(leaf), pa.array([row["subroot"].hex()] * m), pa.array(proof), pa.array(folded)],
                    names=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])

    found = lowest.mapInArrow(judge, f"doc_id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string")
    root = F.lit(manifest.root().first()[0]) if manifest.subroots.limit(1).count() else F.lit(None).cast("string")
    return found.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
