"""Sharding of indivisible groups by best-fit-decreasing bin packing.

Groups (rows of equal text) are never split. All groups enter, largest first, the bin with the tightest remaining
capacity that still holds them, found in an AVL tree over (remaining capacity, bin). Groups of equal
size are interchangeable, and the tightest bin stays the tightest until it is full for that size, so the packer takes
one (size, count) for each distinct size: of groups of ``t`` bytes in all, these are at most the square root of ``2 t``. Its
answer are runs: so many groups of this size go into that shard. Groups are numbered within their size by
shuffles, and take the shard of the run that holds their number. The shards' capacity starts at the least that
any packing needs and grows until the groups fit into ``n_shards`` bins; bisection then looks for a smaller one.

Null and empty texts are one group of text size 0. A group larger than a mean shard gets a shard
that is larger than the others. Ties go by the text's digest, rows of a shard are
numbered by (group, id), equal rows in any order. An empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, join_hot_apart, numbered

#: Runs that are broadcast at most.
FEW_RUNS = 200_000


class _Node:
    __slots__ = ("height", "key", "left", "right")

    def __init__(self, key: tuple[int, int]):
        self.key, self.left, self.right, self.height = key, None, None, 1


def _height(node: _Node | None) -> int:
    return node.height if node else 0


def _up(node: _Node) -> None:
    node.height = 1 + max(_height(node.left), _height(node.right))


def _turn_right(node: _Node) -> _Node:
    top = node.left
    node.left, top.right = top.right, node
    _up(node)
    _up(top)
    return top


def _turn_left(node: _Node) -> _Node:
    top = node.right
    node.right, top.left = top.left, node
    _up(node)
    _up(top)
    return top


def _balanced(node: _Node) -> _Node:
    _up(node)
    lean = _height(node.left) - _height(node.right)
    if lean > 1:
        if _height(node.left.left) < _height(node.left.right):
            node.left = _turn_left(node.left)
        return _turn_right(node)
    if lean < -1:
        if _height(node.right.right) < _height(node.right.left):
            node.right = _turn_right(node.right)
        return _turn_left(node)
    return node


class CapacityTree:
    """AVL tree of (remaining capacity, bin)."""

    def __init__(self):
        self.root: _Node | None = None

    def add(self, key: tuple[int, int]) -> None:
        def put(node: _Node | None) -> _Node:
            if node is None:
                return _Node(key)
            if key < node.key:
                node.left = put(node.left)
            else:
                node.right = put(node.right)
            return _balanced(node)

        self.root = put(self.root)

    def remove(self, key: tuple[int, int]) -> None:
        def cut(node: _Node | None, key: tuple[int, int]) -> _Node | None:
            if node is None:
                return None
            if key < node.key:
                node.left = cut(node.left, key)
            elif key > node.key:
                node.right = cut(node.right, key)
            elif node.left is None or node.right is None:
                return node.left or node.right
            else:
                least = node.right
                while least.left:
                    least = least.left
                node.key = least.key
                node.right = cut(node.right, least.key)
            return _balanced(node)

        self.root = cut(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The least key whose remaining capacity holds ``size``."""
        node, best = self.root, None
        while node:
            if node.key[0] >= size:
                best, node = node.key, node.left
            else:
                node = node.right
        return best


def best_fit_decreasing(units: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Runs (size, first number, bin, groups) of (size, count), given largest first; None beyond ``most`` bins.

    A group over capacity gets a bin alone.
    """
    tree, bins, out = CapacityTree(), 0, []
    for size, count in units:
        at = 0
        while at < count:
            found = tree.tightest(size)
            if found is None:
                if bins == most:
                    return None
                found = (max(capacity, size), bins)
                bins += 1
            else:
                tree.remove(found)
            take = min(count - at, found[0] // size) if size else count - at
            out.append((size, at, found[1], take))
            at += take
            tree.add((found[0] - take * size, found[1]))
    return out


def least_capacity(units: list[tuple[int, int]], n_shards: int) -> int:
    """What the largest shard holds at least: groups larger than the mean of the rest are alone."""
    rest, bins = sum(s * c for s, c in units), n_shards
    for size, count in units:
        for _ in range(count):
            if bins == 1 or size * bins <= rest:
                return -(-rest // bins)
            rest, bins = rest - size, bins - 1
    return 0


def pack_shards(units: list[tuple[int, int]], n_shards: int) -> list[tuple[int, int, int, int]]:
    """The runs of a packing into ``n_shards`` bins of nearly the least capacity."""
    low = least_capacity(units, n_shards)
    step, high, best = 1, low, best_fit_decreasing(units, low, n_shards)
    while best is None:
        low, high, step = high + 1, high + step, 2 * step
        best = best_fit_decreasing(units, high, n_shards)
    while low < high:
        mid = (low + high) // 2
        found = best_fit_decreasing(units, mid, n_shards)
        if found is None:
            low = mid + 1
        else:
            high, best = mid, found
    return best


def shard_documents(spark: SparkSession, docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", row_cost: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of ``docs``."""
    ws = Workspace(spark, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = ws.table("rows", docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + row_cost).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("grp")))
    groups = ws.table("groups", base.groupBy("grp").agg(F.sum("size").alias("total")))
    sizes = groups.groupBy("total").count().toArrow()  # one row a distinct size
    units = sorted(zip(sizes["total"].to_pylist(), sizes["count"].to_pylist(), strict=True), reverse=True)
    packed = pack_shards(units, n_shards)
    kinds = (("run_size", pa.int64()), ("first", pa.int64()), ("shard", pa.int32()), ("n", pa.int64()))
    runs = spark.createDataFrame(pa.table({c: pa.array([r[i] for r in packed], k) for i, (c, k) in enumerate(kinds)}))
    runs = F.broadcast(runs) if len(packed) <= FEW_RUNS else ws.table("runs", runs)
    ranked = numbered(ws, groups, "total", ["grp"], "ranked", "rank")
    inside = (F.col("total") == F.col("run_size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    homes = ws.table("homes", ranked.join(runs, inside).select("grp", "shard"))
    placed = join_hot_apart(base, homes, "grp")
    return numbered(ws, placed, "shard", ["grp", "doc_id"], "slots", "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def op10_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 of near-equal bytes, equal texts together."""
    out = shard_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
