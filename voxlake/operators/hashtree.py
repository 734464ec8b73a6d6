"""Comparing large sets of document versions by hash trees: only branches that differ are read and joined."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.operators.documents import index_differences

#: Bits of a key's hash that name its leaf, and bits of a step from a node to its children.
LEAF_BITS, STEP_BITS = 12, 4
#: What is compared: a document's content, and the index version that it was made for.
ASPECTS = ("content", "version")


def _digest(*parts: str) -> Column:
    return F.xxhash64(*(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts))


@dataclass
class HashTree:
    """A stored set of (document_key, content_hash, index_version) by ranges of key hashes, and for each node of a tree above them count, sum and
    exclusive or of its rows' digests, for content and version apart. An index without versions has a null one."""

    spark: SparkSession
    path: str
    leaf_bits: int = LEAF_BITS

    def build(self, rows: DataFrame) -> HashTree:
        version = "index_version" if "index_version" in rows.columns else F.lit(None).cast("string").alias("index_version")
        leaf = F.shiftrightunsigned(F.xxhash64("document_key"), 64 - self.leaf_bits)
        held = rows.select("document_key", "content_hash", version).withColumn("leaf", leaf)
        held.repartitionByRange("leaf").sortWithinPartitions("leaf", "document_key").write.parquet(f"{self.path}/rows")
        held = self.rows().withColumns({"content": _digest("document_key", "content_hash"), "version": _digest("document_key", "index_version")})
        sums = [F.sum("n").alias("n"), *(f(f"{a}_{k}").alias(f"{a}_{k}") for a in ASPECTS for k, f in (("sum", F.sum), ("xor", F.bit_xor)))]
        wide = held.select("leaf", F.lit(1).cast("long").alias("n"), *(x for a in ASPECTS for x in (F.col(a).cast("decimal(38,0)").alias(f"{a}_sum"), F.col(a).alias(f"{a}_xor"))))
        level = wide.withColumnRenamed("leaf", "node")
        for depth in range(self.depth, -1, -1):
            level.groupBy("node").agg(*sums).write.parquet(f"{self.path}/level={depth}")
            level = self.level(depth).withColumn("node", F.shiftright("node", STEP_BITS))
        return self

    @property
    def depth(self) -> int:
        return self.leaf_bits // STEP_BITS

    def rows(self, leaves: list[int] | None = None) -> DataFrame:
        """The rows, or those of some leaves: files and row groups of others are stepped over."""
        found = self.spark.read.parquet(f"{self.path}/rows")
        return found if leaves is None else found.filter(F.col("leaf").isin(leaves))

    def level(self, depth: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/level={depth}")


def unequal_leaves(a: HashTree, b: HashTree, aspects: tuple[str, ...] = ASPECTS) -> list[int]:
    """Leaves in which two sets differ, from the root down; at each depth only children of unequal nodes are read, never more than there are leaves."""
    own = [f"{x}_{k}" for x in aspects for k in ("sum", "xor")]
    nodes = [0]
    for depth in range(a.depth + 1):
        sides = [t.level(depth).filter(F.col("node").isin(nodes)).select("node", F.struct("n", *own).alias(name)) for t, name in ((a, "a"), (b, "b"))]
        found = [r["node"] for r in sides[0].join(sides[1], "node", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("node").collect()]
        if depth == a.depth or not found:
            return sorted(found)
        nodes = [(n << STEP_BITS) + i for n in found for i in range(1 << STEP_BITS)]
    return []


def tree_differences(expected: HashTree, registry: HashTree, index: HashTree) -> DataFrame:
    """What documents.index_differences() finds, from the rows of the leaves in which expected documents and registry, or the contents of registry and index, differ."""
    leaves = sorted({*unequal_leaves(expected, registry), *unequal_leaves(registry, index, ("content",))})
    return index_differences(expected.rows(leaves), registry.rows(leaves), index.rows(leaves).drop("index_version"))
