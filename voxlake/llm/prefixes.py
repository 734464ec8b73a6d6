"""Conversation prefix trie by truncation peeling, from the deepest turn to the root."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import forget, new_folder, stored, table
from voxlake.operators.scans import numbered, running

#: Conversations of a family share the first turns of its first one; at most HEAD of them.
FAMILY, HEAD = 20, 4
#: Most depths of a band; bands double up to that.
BAND = 64
#: Ids of a chunk of a node's ends: those that agree in all but so many low bits.
CHUNK_BITS = 16
#: A prefix: the sums of four digest lanes over its turns.
KEY = "struct<k0: bigint, k1: bigint, k2: bigint, k3: bigint>"
WORD = r"[^\x20\x09-\x0D]+"
#: What a surviving node carries: its smallest member and what its subtree holds.
STATE = ("conv_id", "n_convs", "n_children", "n_leaves", "saved")


def lanes(text: Column) -> list[Column]:
    """128 bits of a digest as four numbers, whose sums along a conversation stand for its prefixes."""
    digest = F.md5(text)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, digest, words) of the rebuilt conversations, and each one's length (conv_id, n).

    Every conversation c takes the first crc32(c) % HEAD turns of conversation c - c % FAMILY (all, if fewer) in place of
    as many of its own. Turns are ordered by turn, null first, ties by role and the digest of role and text.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), F.md5(F.concat_ws(":", F.length(role), role, text)).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    turns = numbered(rows.filter("conv_id is not null"), "conv_id", ["turn", "role", "digest"]).select("conv_id", "number", "digest", "words")
    own = turns.groupBy("conv_id").agg(F.max("number").alias("n")).withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % HEAD, "source": F.expr(f"conv_id - conv_id % {FAMILY}")})
    heads = turns.filter(F.col("number") < HEAD).groupBy(F.col("conv_id").alias("source")).agg(F.array_sort(F.collect_list(F.struct("number", "digest", "words"))).alias("head"))
    convs = own.join(heads, "source", "left").withColumn("head", F.expr("slice(coalesce(head, array()), 1, cast(h as int))"))
    taken = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.number").alias("depth"), "t.digest", "t.words")
    size = F.size("head").cast("long")
    kept = turns.join(convs.select("conv_id", "h", size.alias("k")), "conv_id").filter("number > h").select("conv_id", F.expr("number - h + k").alias("depth"), "digest", "words")
    return taken.unionByName(kept), convs.select("conv_id", (size + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def band_of(depth: Column) -> Column:
    """Bands 1, 2, 3-4, 5-8 and so on up to BAND depths, from there BAND depths each."""
    doubling = F.ceil(F.log2(F.greatest(depth, F.lit(1)).cast("double"))).cast("long")
    return F.when(depth <= BAND, doubling).otherwise(F.floor((depth - 1) / BAND) + BAND.bit_length() - 1)


def band_floor(band: int) -> int:
    """The depth above a band's first."""
    top = BAND.bit_length() - 1
    return (0 if band == 0 else 1 << (band - 1)) if band <= top else (band - top) * BAND


def ends_digests(ends: DataFrame) -> DataFrame:
    """depth, key and SHA-256 of the ascending, comma-joined conv_ids of ends (depth, key, conv_id), which are distinct.

    Ids are joined in chunks of neighbouring ids, at most 2**CHUNK_BITS; a node's chunks then stream through one task in order, a chunk
    in memory at a time (the digest itself is sequential).
    """
    chunk = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = ends.groupBy("depth", "key", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(chunk.alias("ids"))
    parts = chunks.repartition("depth", "key").sortWithinPartitions("depth", "key", "chunk").select("depth", "key", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None

        def out(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[0][0] for d in done], pa.int64()), pa.array([d[0][1] for d in done], key_type), pa.array([d[1] for d in done], pa.string())], names=["depth", "key", "ends_sha256"])

        key_type = None
        for batch in batches:
            key_type, done = batch.schema.field(1).type, []
            for depth, key, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if node == (depth, key):
                    digest.update(b"," + ids.encode())
                    continue
                if node is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = (depth, key), hashlib.sha256(ids.encode())
            yield out(done)
        if node is not None:
            yield out([(node, digest.hexdigest())])

    return parts.mapInArrow(run, f"depth long, key {KEY}, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations' prefixes; one row a node, see peel() for the columns.

    Null roles and texts count as empty; rows without a conv_id take no part; a repeated row is a turn more; very long
    texts are taken whole; further columns are ignored; without conversations there is no node. A prefix is known by the
    sum of 128-bit digests of its turns and their depths.
    """
    turns, lengths = rebuilt(conversations)
    own = lanes(F.concat_ws(":", "depth", "digest"))
    turns = running(turns.withColumns({f"l{i}": x for i, x in enumerate(own)}), "conv_id", "depth", {f"b{i}": F.sum(f"l{i}") for i in range(4)})
    base = [F.coalesce(f"b{i}", F.lit(0)) for i in range(4)]
    base_key, key = F.struct(*(b.alias(f"k{i}") for i, b in enumerate(base))), F.struct(*((b + F.col(f"l{i}")).alias(f"k{i}") for i, b in enumerate(base)))
    return peel(turns.select("conv_id", "depth", base_key.alias("base"), key.alias("key"), "words"), lengths)


NODE = f"conv_id long, depth long, key {KEY}, above {KEY}, n_convs long, n_children long, n_leaves long, saved long"


def peel(prefixes: DataFrame, lengths: DataFrame) -> DataFrame:
    """The trie of prefixes (conv_id, depth, base: the key above, key, words) of conversations of these lengths (conv_id, n).

    From the greatest depth up: conversations that end at a depth join the nodes that survive there, equal prefixes
    become one node, and each node loses its last turn. Nodes are discovered and their subtrees summed in the same pass, and
    each depth's nodes are a table in the shared folder. A node that meets no other within a band of depths is
    stripped of the band's turns at once. Merging is a grouping with map-side combination, so a prefix that a third of all
    conversations share is a row a task.

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    spark = prefixes.sparkSession
    zero = F.lit(0).cast("long")
    root = F.struct(*(zero.alias(f"k{i}") for i in range(4)))
    path_folder, top_folder, nodes = (new_folder(spark, x) for x in ("paths", "tops", "nodes"))
    spread = F.pmod(F.xxhash64("conv_id"), F.lit(16))

    paths = prefixes.groupBy("conv_id", band_of(F.col("depth")).alias("band")).agg(F.array_sort(F.collect_list(F.struct("depth", "key", "words"))).alias("steps"), F.min_by("base", "depth").alias("base"))
    paths.repartition("band", spread).write.partitionBy("band").parquet(path_folder)
    paths = spark.read.schema(paths.schema).parquet(path_folder)
    last = paths.join(lengths.filter("n > 0").select("conv_id", "n", band_of(F.col("n")).alias("band")), ["conv_id", "band"]).select("conv_id", F.col("n").alias("depth"), F.element_at("steps", -1)["key"].alias("key"))
    ended = stored(lengths.filter("n = 0").select("conv_id", zero.alias("depth"), root.alias("key")).unionByName(last), "ends")
    tops = ended.groupBy("depth", "key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    tops = tops.select("conv_id", "n_convs", *(zero.alias(c) for c in STATE[2:]), "depth", F.when(F.col("depth") > 0, band_of(F.col("depth"))).otherwise(-1).alias("band"))
    tops.repartition("band", spread).write.partitionBy("band").parquet(top_folder)
    tops = spark.read.schema(tops.schema).parquet(top_folder)

    def stripped(level: DataFrame, *more: Column) -> DataFrame:
        """Nodes of a depth without their last turn: each is one child of the node above."""
        return level.select("conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved", *more)

    def written(level: DataFrame, name: str) -> DataFrame:
        level.write.parquet(f"{nodes}/at={name}")
        return spark.read.schema(level.schema).parquet(f"{nodes}/at={name}")

    living: list[DataFrame] = []
    highest = tops.agg(F.max("band")).first()[0]
    for band in range(-1 if highest is None else highest, -1, -1):
        floor = band_floor(band)
        entries = tops.filter(F.col("band") == band).select(*STATE, "depth")
        for nodes_above in living:
            entries = entries.unionByName(nodes_above.withColumn("depth", F.lit(band_floor(band + 1)).cast("long")))
        path = paths.filter(F.col("band") == band).select("conv_id", "steps", "base")
        entries = meeting = stored(entries.join(path, "conv_id").withColumn("steps", F.expr(f"slice(steps, 1, cast(depth - {floor} as int))")), "entries")
        living = []
        if floor:
            shared = entries.groupBy("base").agg(F.count("*").alias("n")).filter("n > 1").select("base")
            alone = written(chains(entries.join(shared, "base", "left_anti")), f"chain{band}")
            living.append(stripped(alone.filter(F.col("depth") == floor + 1)))
            meeting = entries.join(shared, "base", "left_semi")
        going = None
        for depth in range(meeting.agg(F.max("depth")).first()[0] or floor, floor, -1):
            here = meeting.filter(F.col("depth") == depth).select(*STATE, "steps", "base")
            level = written(merged(here if going is None else here.unionByName(going), depth), f"depth{depth}")
            going = stripped(level, F.expr("slice(steps, 1, size(steps) - 1)").alias("steps"), "base")
        if going is not None:
            living.append(going.drop("steps", "base"))
        forget(entries)
    top = tops.filter("band = -1").select(*STATE)
    for level in living:
        top = top.unionByName(level)
    top = top.agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in STATE[1:])).filter("n_convs > 0")
    top = stored(top.select("conv_id", zero.alias("depth"), root.alias("key"), F.lit(None).cast(KEY).alias("above"), "n_convs", "n_children", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"), "saved"), "root")
    forget(paths, tops)
    found = top if highest is None or highest < 0 else top.unionByName(spark.read.schema(NODE).parquet(nodes).select(*top.columns))
    parents = found.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    found = found.join(parents, ["depth", "above"], "left").join(ends_digests(ended), ["depth", "key"], "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def merged(rows: DataFrame, depth: int) -> DataFrame:
    """The nodes of one depth: rows are ended conversations and stripped children, whose last step is at that depth."""
    rows = rows.withColumn("step", F.element_at("steps", -1))
    level = rows.groupBy("step.key").agg(F.min_by(F.struct("steps", "base", "step"), "conv_id").alias("p"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in STATE[1:]))
    above = F.when(F.size("p.steps") > 1, F.expr("try_element_at(p.steps, size(p.steps) - 1).key")).otherwise(F.col("p.base"))
    saved = F.col("saved") + (F.col("n_convs") - 1) * F.col("p.step.words")
    leaves = F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long")
    return level.select("conv_id", F.lit(depth).cast("long").alias("depth"), "key", above.alias("above"), "n_convs", "n_children", leaves.alias("n_leaves"), saved.alias("saved"), "p.steps", "p.base")


def chains(entries: DataFrame) -> DataFrame:
    """All nodes of entries that meet no other in their band: from an entry's last step up, each has the next one as its only child."""
    each = entries.select("*", F.posexplode("steps").alias("i", "step")).withColumn("is_last", F.expr("i = size(steps) - 1"))
    words = F.expr("aggregate(slice(steps, i + 1, size(steps)), 0L, (a, s) -> a + s.words)")
    above = F.when(F.col("i") > 0, F.expr("try_element_at(steps, i).key")).otherwise(F.col("base"))
    leaves = F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long")
    children = F.when(F.col("is_last"), F.col("n_children")).otherwise(1).cast("long")
    return each.select("conv_id", "step.depth", "step.key", above.alias("above"), "n_convs", children.alias("n_children"), leaves.alias("n_leaves"), (F.col("saved") + (F.col("n_convs") - 1) * words).alias("saved"))


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: crc32 of an ASCII text and the rebuilt conversations in DuckDB, then each node from its members; n_leaves and saved_tokens from the nodes below.
OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(concat_ws(':', length(coalesce(role, '')), coalesce(role, ''), coalesce(text, '')))) AS number,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
steps AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM turns),
crc AS (
  WITH RECURSIVE go AS (
    SELECT conv_id, s, 0 AS i, 4294967295::UBIGINT AS c FROM steps
    UNION ALL
    SELECT conv_id, s, i + 1, CASE WHEN i % 9 = 0 THEN xor(c, ascii(substr(s, i // 9 + 1, 1))::UBIGINT) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END
    FROM go WHERE i < 9 * length(s))
  SELECT conv_id, xor(c, 4294967295::UBIGINT) % 4 AS h FROM go WHERE i = 9 * length(s)),
rebuilt AS (
  SELECT crc.conv_id, t.number AS spot, t.role, t.text FROM crc JOIN turns t ON t.conv_id = crc.conv_id - crc.conv_id % 20 AND t.number <= h
  UNION ALL SELECT crc.conv_id, t.number + 10, t.role, t.text FROM crc JOIN turns t USING (conv_id) WHERE t.number > h),
numbered AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY spot) AS depth, length(role) || ':' || role || text AS turn, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM rebuilt),
paths AS (
  SELECT conv_id, depth, md5(string_agg(md5(turn), ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS key, words FROM numbered
  UNION ALL SELECT conv_id, 0, '', 0 FROM crc),
members AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS above, depth = max(depth) OVER (PARTITION BY conv_id) AS is_end FROM paths),
nodes AS (
  SELECT depth, key, above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256
  FROM members GROUP BY ALL),
below AS (
  SELECT a.depth, a.key, count(*) FILTER (WHERE n.depth = a.depth + 1) AS n_children, count(*) FILTER (WHERE NOT EXISTS (FROM nodes c WHERE c.depth = n.depth + 1 AND c.above = n.key)) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM nodes n JOIN paths a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, b.n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.depth = n.depth AND b.key = n.key LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = n.above
"""
