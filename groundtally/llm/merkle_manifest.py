"""Merkle manifest of a dataset: one tree a group of rows, one tree over the groups, stored in van Emde Boas order.

A tree is cut into aligned blocks of ``ARITY ** BLOCK_HEIGHT`` leaves. Each block is a subtree that is
built in one group of rows and stored as one row, its nodes in van Emde Boas order: the upper half of
the levels first, then the subtrees below one after the other, each laid out the same way. The place of
a node follows from its level and index alone, so building a block and reading siblings out of it need
no pointers. The roots of the blocks are the leaves of the next store, until one block is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundtally.llm.common import written

ARITY, BLOCK_HEIGHT = 16, 3
SPAN = ARITY ** BLOCK_HEIGHT
HEX = 64  # characters of a digest

STORE = "grp string, block long, n long, leaves int, levels int, nodes binary, root binary"
PATH = "array<struct<before:string,after:string>>"


# ------------------------------------------------------------------------------ layout
def level_sizes(leaves: int, levels: int) -> list[int]:
    """Nodes of each level, leaves first; the last run of a level may be short."""
    return [-(-leaves // ARITY ** k) for k in range(levels)]


def levels_of(leaves: int) -> int:
    """Levels of a tree that ends as soon as one node is left."""
    levels = 1
    while leaves > 1:
        leaves, levels = -(-leaves // ARITY), levels + 1
    return levels


def address(leaves: int, levels: int, level: int, index: np.ndarray) -> np.ndarray:
    """Places of nodes ``index`` of ``level`` (0 is the leaves) in the van Emde Boas order of a tree.

    The lower half of the levels is a row of subtrees behind the upper half. Only the last of them can be short, so
    those before it are all of one size and a subtree's start is a product.
    """
    if levels == 1:
        return np.zeros_like(index)
    low = levels // 2
    upper = -(-leaves // ARITY ** low)
    if level >= low:
        return address(upper, levels - low, level - low, index)
    span, width = ARITY ** (low - 1), ARITY ** (low - 1 - level)
    tree = index // width
    inside, last = index - tree * width, (leaves - 1) // span
    start = sum(level_sizes(upper, levels - low)) + tree * sum(level_sizes(span, low))
    return start + np.where(tree == last, address(leaves - last * span, low, level, inside), address(span, low, level, inside))


def lay_out(digests: bytes, levels: int) -> np.ndarray:
    """All nodes of a block, hashed level by level at their places; 32 bytes each."""
    leaves = len(digests) // 32
    sizes = level_sizes(leaves, levels)
    nodes = np.zeros((sum(sizes), 32), np.uint8)
    nodes[address(leaves, levels, 0, np.arange(leaves))] = np.frombuffer(digests, np.uint8).reshape(-1, 32)
    for level, size in enumerate(sizes[1:], 1):
        below = level_text(nodes, leaves, levels, level - 1)
        run = ARITY * HEX
        made = b"".join(hashlib.sha256(below[k * run:(k + 1) * run].encode()).digest() for k in range(size))
        nodes[address(leaves, levels, level, np.arange(size))] = np.frombuffer(made, np.uint8).reshape(-1, 32)
    return nodes


def level_text(nodes: np.ndarray, leaves: int, levels: int, level: int) -> str:
    """The digests of a level in order, as one hex string."""
    return nodes[address(leaves, levels, level, np.arange(level_sizes(leaves, levels)[level]))].tobytes().hex()


def sibling_reader(nodes: bytes, leaves: int, levels: int):
    """A function from a leaf's index to its (before, after) siblings, level by level up to the block's root."""
    laid = np.frombuffer(nodes, np.uint8).reshape(-1, 32)
    texts = [level_text(laid, leaves, levels, k) for k in range(levels - 1)]

    def read(index: int) -> list[tuple[str, str]]:
        out = []
        for text in texts:
            first = index // ARITY * ARITY
            out.append((text[first * HEX:index * HEX], text[(index + 1) * HEX:(first + ARITY) * HEX]))
            index //= ARITY
        return out

    return read


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for before, after in path:
        digest = hashlib.sha256((before + digest + after).encode()).hexdigest()
    return digest


# ------------------------------------------------------------------------------ rows to leaves
def field(value: Column) -> Column:
    """A value as the leaf hashes it: ``-`` for null, else its UTF-8 length, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.encode(F.concat(*[field(v) for v in values]), "UTF-8"), 256))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``rank`` (from 0, inside ``grp`` in the given order) and ``n`` (rows of the group).

    Rows are dealt by range over group and order, so that a large group spans many partitions; a number of their own tells
    equal rows apart, so that they do too. Ranks are places inside a partition plus what the partitions before it hold of the group.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["grp", *order, "twin"]
    dealt = rows.withColumn("twin", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = written(dealt.drop("twin").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    group = Window.partitionBy("grp")
    shares = placed.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("held")).select(
        "grp", "part", "first", F.sum("held").over(group).alias("n"),
        F.coalesce(F.sum("held").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    return placed.join(shares, ["grp", "part"]).withColumn("rank", F.col("earlier") + F.col("at") - F.col("first")).drop("part", "first", "earlier", "at")


def _in_blocks(ranks: DataFrame) -> DataFrame:
    return ranks.withColumn("block", F.floor(F.col("rank") / SPAN)).withColumn("place", (F.col("rank") % SPAN).cast("int"))


# ------------------------------------------------------------------------------ stores
def _build_block(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("place")
    n = rows["n"][0].as_py()
    levels = levels_of(n) if n <= SPAN else BLOCK_HEIGHT + 1
    nodes = lay_out(b"".join(rows["digest"].to_pylist()), levels)
    root = nodes[address(rows.num_rows, levels, levels - 1, np.zeros(1, np.int64))[0]].tobytes()
    return pa.table({"grp": [key[0].as_py()], "block": [key[1].as_py()], "n": [n], "leaves": pa.array([rows.num_rows], pa.int32()),
                     "levels": pa.array([levels], pa.int32()), "nodes": [nodes.tobytes()], "root": [root]})


def build_stores(nodes: DataFrame) -> list[DataFrame]:
    """Blocks over (grp, rank, n, digest), then blocks over their roots, until every group has one.

    The number of stores is the logarithm of the largest group to the base of 4,096. A store's row holds at most 4,369 nodes.
    """
    stores = []
    while True:
        store = written(_in_blocks(nodes).select("grp", "block", "place", "n", "digest").groupBy("grp", "block").applyInArrow(_build_block, STORE))
        stores.append(store)
        nodes = store.filter(F.col("n") > SPAN).select(
            "grp", F.col("block").alias("rank"), F.ceil(F.col("n") / SPAN).alias("n"), F.col("root").alias("digest"))
        if nodes.isEmpty():
            return stores


def group_roots(stores: list[DataFrame]) -> DataFrame:
    """(grp, root) of every group, out of the store in which it fits into one block."""
    found = stores[0].filter(F.col("n") <= SPAN)
    for store in stores[1:]:
        found = found.unionByName(store.filter(F.col("n") <= SPAN))
    return found.select("grp", "root")


def _leaf_paths(blocks: DataFrame) -> DataFrame:
    """(grp, block of the store below, path, subroot, root): every leaf of a store's blocks with its siblings up to the top."""
    schema = f"grp string, block long, path {PATH}, subroot string, root string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.struct([("before", pa.string()), ("after", pa.string())])
        for batch in batches:
            for row in batch.to_pylist():
                read = sibling_reader(row["nodes"], row["leaves"], row["levels"])
                above = [(p["before"], p["after"]) for p in row["path"]]
                places = range(row["leaves"])
                paths = [[{"before": b, "after": a} for b, a in read(k) + above] for k in places]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["grp"]] * len(places)), pa.array([row["block"] * SPAN + k for k in places], pa.int64()), pa.array(paths, pa.list_(kinds)),
                    pa.array([row["subroot"]] * len(places), pa.string()), pa.array([row["top"]] * len(places), pa.string())],
                    names=["grp", "block", "path", "subroot", "root"])

    return blocks.mapInArrow(run, schema)


def block_paths(stores: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(grp, block, path, subroot, root) of the blocks of the first store, read downwards from ``tops`` (grp, path, subroot, root)."""
    known = None
    for store in reversed(stores):
        own = store.filter(F.col("n") <= SPAN).select("grp", "block").join(tops, "grp").select("grp", "block", "path", "subroot", "root")
        paths = own if known is None else own.unionByName(known)
        if store is not stores[0]:
            known = _leaf_paths(store.join(paths.withColumnRenamed("root", "top"), ["grp", "block"]))
    return paths


# ------------------------------------------------------------------------------ manifest
@dataclass(frozen=True)
class Manifest:
    """``rows`` are the leaves with their ranks, ``stores`` the blocks of the groups' trees, ``top_stores`` those of the tree over groups.

    ``groups`` ranks the groups' roots.
    """

    rows: DataFrame
    stores: list[DataFrame]
    groups: DataFrame
    top_stores: list[DataFrame]

    def root(self) -> DataFrame:
        """One row with the hex root; none for an empty dataset."""
        return group_roots(self.top_stores).select(F.lower(F.hex("root")).alias("root"))

    def save(self, path: str) -> None:
        """The manifest itself: every block of every store, as Parquet under ``path``."""
        for name, stores in (("groups", self.stores), ("top", self.top_stores)):
            for k, store in enumerate(stores):
                store.write.parquet(f"{path}/{name}-{k}")


def build_manifest(docs: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "source", claimed: Column | None = None) -> Manifest:
    """Trees of 16 children over the rows of each group in ascending order of id, and one over the groups.

    A leaf hashes ``columns`` in turn. ``claimed`` is the leaf that a holder of the row presents instead of the true one (null: the
    true one); see :func:`proofs`. Groups ascend bytewise, the null group first. Null ids come first in a group; rows with
    one id are ordered by leaf, and rows that are equal altogether have equal leaves, so their order is free. Null and
    empty texts have different leaves. A long text is hashed where it lies and never moves. An empty table has no root and no proofs. Other
    columns aren't read, so their names are free.
    """
    group = F.coalesce(F.concat(F.lit("="), docs[group_col].cast("string")), F.lit(""))  # null sorts before the empty group
    leaves = written(docs.select(docs[id_col].alias("id"), group.alias("grp"), leaf_digest(*[docs[c] for c in columns]).alias("digest"),
                                 (claimed if claimed is not None else F.lit(None).cast("binary")).alias("claimed")))
    rows = ranked(leaves, "id", "digest")
    stores = build_stores(rows.select("grp", "rank", "n", "digest"))
    roots = group_roots(stores).select(F.lit("").alias("grp"), F.col("grp").alias("member"), F.col("root").alias("digest"))
    groups = ranked(roots, "member")
    return Manifest(rows, stores, groups, build_stores(groups.select("grp", "rank", "n", "digest")))


def _fold_rows(rows: pa.Table, blocks: pa.Table) -> pa.Table:
    block = blocks.to_pylist()[0]
    read = sibling_reader(block["nodes"], block["leaves"], block["levels"])
    above = [(p["before"], p["after"]) for p in block["path"]]
    tail = "".join(b + a for b, a in above)
    out: dict[str, list] = {"leaf": [], "proof": [], "folded": []}
    for place, digest, claimed in zip(rows["place"].to_pylist(), rows["digest"].to_pylist(), rows["claimed"].to_pylist()):
        path = read(place)
        out["leaf"].append(digest.hex())
        out["proof"].append(hashlib.sha256(("".join(b + a for b, a in path) + tail).encode()).hexdigest())
        out["folded"].append(fold((claimed or digest).hex(), path + above))
    same = lambda name: pa.array([block[name]] * rows.num_rows, pa.string())
    return pa.table({"id": rows["id"], "leaf": out["leaf"], "subroot": same("subroot"), "root": same("top"), "proof_sha256": out["proof"], "folded_root": out["folded"]})


def proofs(manifest: Manifest) -> DataFrame:
    """One row per row of the dataset: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Siblings come out of the blocks: those of the row's own block by its place in it, those above from the block's path, which is read
    downwards from the top store once a block. ``proof_sha256`` digests them all, bottom up and left to right. ``folded_root`` is what
    the claimed leaf leads to.
    """
    tops = block_paths(manifest.top_stores, group_roots(manifest.top_stores).select(
        "grp", F.array().cast(PATH).alias("path"), F.lit("").alias("subroot"), F.lower(F.hex("root")).alias("root")))
    members = _leaf_paths(manifest.top_stores[0].join(tops.withColumnRenamed("root", "top"), ["grp", "block"])).select(
        F.col("block").alias("rank"), "path", "root")
    of_group = manifest.groups.select("rank", F.col("member").alias("grp"), F.lower(F.hex("digest")).alias("subroot")).join(members, "rank").drop("rank")
    paths = block_paths(manifest.stores, of_group).withColumnRenamed("root", "top")
    blocks = manifest.stores[0].select("grp", "block", "leaves", "levels", "nodes").join(paths, ["grp", "block"])
    rows = _in_blocks(manifest.rows).select("grp", "block", "place", "id", "digest", "claimed")
    kind = manifest.rows.schema["id"].dataType.simpleString()
    found = rows.groupBy("grp", "block").cogroup(blocks.groupBy("grp", "block")).applyInArrow(
        _fold_rows, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
