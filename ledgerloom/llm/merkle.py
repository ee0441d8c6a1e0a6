"""Merkle manifest of a table: a tree for each group (language) of rows, and a tree over the groups' roots.

A leaf is the SHA-256 of a row's fields, each ``-`` if null, else its UTF-8 length, a colon and the value. Rows of a group
ascend by id and, if ids repeat, by leaf; a null id comes first. Two neighbours become the hash of both digests, a last one without neighbour
the hash of its own, until one is left.

Rows are numbered by ranges, so a group that holds most rows is spread over all tasks. ``BUCKET`` (a power of two) consecutive rows
of a group are an aligned bucket: a subtree that needs nothing else. Each bucket goes as an Arrow table to a DuckDB connection of the worker, where an ordered
``string_agg`` with ``sha256`` makes one level after the other; the same connection gathers each row's siblings and folds
the row's (tampered) leaf with them to a root of the bucket. A bucket that isn't its group's only one always has as many
levels as a full one. Spark combines the buckets' roots level by level, then the groups' roots, hands the outer siblings
down from the roots (a parent has two children, so no key is hot), joins them to the rows and folds on.

Null values hash as said; a null group comes first, all others by their UTF-8 bytes. Empty and very long texts are values
like others. Repeated rows are leaves of their own. An empty table gives an empty result. Other columns aren't read; names don't clash, as rows get names of
their own first.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, numbered

#: Rows a bucket, a power of two; roots of groups or buckets that go to all tasks at most.
BUCKET, FEW = 1 << 12, 1 << 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(fields: list[Column]) -> Column:
    """The digest of a row with these values."""
    shown = [F.coalesce(F.concat(F.octet_length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string")), F.lit("-")) for x in fields]
    return F.sha2(F.concat(*shown), 256)


def leaves(docs: DataFrame, group: str = "lang", tampered: str = "n_chars") -> DataFrame:
    """tree (null groups first), id, leaf, and the leaf after tampering (null where the row isn't tampered with)."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    fields = {c: F.col(c) for c in FIELDS}
    changed = fields | {tampered: F.col(tampered) + 1}
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("id"), leaf([*fields.values()]).alias("leaf"), F.when(hit, leaf([*changed.values()])).alias("forged"))


_DUCK = []


def duck():
    """The worker's DuckDB, of one thread, bounded and without files."""
    if not _DUCK:
        import duckdb

        _DUCK.append(duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""}))
    return _DUCK[0]


#: A level's nodes from the level below, the siblings of all rows from the first level up, and a level's step of the fold.
LEVEL = "insert into node select {up}, pos >> 1, sha256(string_agg(h, '' order by pos)) from node where level = {at} group by pos >> 1"
SIBLINGS = """create or replace table proof as select r.pos, coalesce(string_agg(n.h, '' order by n.level), '') as inner_proof
 from row r left join node n on n.level < {height} and n.pos = xor(r.pos >> n.level, 1) group by r.pos"""
FOLD = """create or replace table fold as select f.pos, sha256(case when (f.pos >> {at}) & 1 = 1 then n.h || f.h else f.h || coalesce(n.h, '') end) as h
 from fold f left join node n on n.level = {at} and n.pos = xor(f.pos >> {at}, 1)"""
INNER = "tree string, bucket long, id long, leaf string, bucket_root string, inner_proof string, inner_fold string"


def _bucket(bucket: int):
    """A bucket's rows to their siblings, the bucket's root, and the root that their leaves fold to."""

    def run(table: pa.Table) -> pa.Table:
        con = duck()
        con.register("given", table)
        con.execute("create or replace table row as select *, num % ? as pos from given", [bucket])
        con.unregister("given")
        con.execute("create or replace table node as select 0 as level, pos, leaf as h from row")
        con.execute("create or replace table fold as select pos, coalesce(forged, leaf) as h from row")
        # Only a group's first and only bucket has fewer levels than a full one.
        lone = table.num_rows < bucket and table.column("bucket")[0].as_py() == 0
        height = (table.num_rows - 1 if lone else bucket - 1).bit_length()
        for at in range(height):
            con.execute(LEVEL.format(at=at, up=at + 1))
            con.execute(FOLD.format(at=at))
        con.execute(SIBLINGS.format(height=height))
        root = con.execute("select h from node where level = ?", [height]).fetchall()[0][0]
        out = con.sql("select r.tree, r.bucket, r.id, r.leaf, ? as bucket_root, p.inner_proof, f.h as inner_fold from row r join proof p using (pos) join fold f using (pos)", params=[root])
        return out.to_arrow_table().cast(pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in INNER.split(", ")]))

    return run


def inner(ws: Workspace, rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Each row of (tree, id, leaf, forged) with what its bucket gives."""
    placed = numbered(ws, rows, "tree", ["id", "leaf"], "leaves", "num").withColumn("bucket", F.shiftright("num", bucket.bit_length() - 1))
    return ws.table("inner", placed.groupBy("tree", "bucket").applyInArrow(_bucket(bucket), INNER))


STEP = "array<struct<h:string,right:boolean>>"


def combine(ws: Workspace, nodes: DataFrame, name: str) -> DataFrame:
    """tree, pos, root and steps (siblings upwards, and whether the node is the right one) for nodes of (tree, pos, h), numbered from 0 in each tree."""
    at, levels, ends = nodes.withColumn("start", F.lit(0)), [], []
    while True:
        pairs = at.groupBy("tree", F.shiftright("pos", 1).alias("up")).agg(F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("children"))
        ended = (F.col("up") == 0) & (F.size("children") == 1)
        pairs = ws.table(f"{name}-{len(levels)}", pairs.withColumn("ended", ended))
        levels.append(pairs)
        ends.append(pairs.where("ended").select("tree", F.col("children")[0]["h"].alias("root")))
        rest = pairs.where("not ended")
        if rest.isEmpty():
            break
        at = rest.select("tree", F.col("up").alias("pos"), F.sha2(F.concat_ws("", "children.h"), 256).alias("h"))
    down = None
    for k in reversed(range(len(levels))):
        found = ends[k].select("tree", F.lit(0).cast("long").alias("pos"), "root", F.array().cast(STEP).alias("steps"))
        if down is not None:
            parents = levels[k].where("not ended").join(down.withColumnRenamed("pos", "up"), ["tree", "up"])
            child = F.explode("children").alias("child")
            step = F.struct(F.expr("get(filter(children, c -> c.pos <> child.pos), 0).h").alias("h"), (F.col("child.pos") % 2 == 1).alias("right"))
            found = found.unionByName(parents.select("tree", "root", "steps", "children", child).select("tree", F.col("child.pos").alias("pos"), "root", F.concat(F.array(step), "steps").cast(STEP).alias("steps")))
        down = ws.table(f"{name}-{k}-steps", found)
    return down


def folded(start: Column, steps: Column) -> Column:
    """The root that a digest and its siblings lead to."""
    both = lambda h, s: F.when(s["right"], F.concat(s["h"], h)).otherwise(F.concat(h, F.coalesce(s["h"], F.lit(""))))
    return F.aggregate(steps, start, lambda h, s: F.sha2(both(h, s), 256))


def small(df: DataFrame, few: int = FEW) -> DataFrame:
    """Marked for all tasks if it is counted to have ``few`` rows at most."""
    return F.broadcast(df) if df.limit(few + 1).count() <= few else df


def manifest(spark: SparkSession, docs: DataFrame, bucket: int = BUCKET, few: int = FEW) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row."""
    ws = Workspace(spark, "merkle")
    rows = inner(ws, ws.table("hashed", leaves(docs)), bucket)  # texts are read once, ranges are drawn from digests
    buckets = rows.groupBy("tree", F.col("bucket").alias("pos")).agg(F.first("bucket_root").alias("h"))
    outer = combine(ws, buckets, "buckets")
    groups = outer.where("pos = 0").select("tree", F.lit("").alias("all"), F.col("root").alias("h"))
    groups = ws.table("groups", numbered(ws, groups, "all", ["tree"], "group-ranges", "pos"))
    top = combine(ws, groups.select(F.col("all").alias("tree"), "pos", "h"), "groups-tree")
    top = groups.select("tree", "pos").join(top.select("pos", "root", F.col("steps").alias("above")), "pos").drop("pos")
    paths = outer.withColumnRenamed("root", "subroot").join(small(top, few), "tree").select("tree", F.col("pos").alias("bucket"), "subroot", "root", F.concat("steps", "above").alias("steps"))
    paths = ws.table("paths", paths)
    ws.keep_only("inner", "paths")
    proof = F.sha2(F.concat("inner_proof", F.concat_ws("", F.transform("steps", lambda s: s["h"]))), 256)
    out = rows.join(small(paths, few), ["tree", "bucket"]).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.col("inner_fold"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and which tampered rows it exposes."""
    return manifest(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
