"""Conversations as a trie of their shared beginnings, each node owned by its smallest member."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm.common import Scratch, materialize, named, shuffle_partitions
from callscope.operators.ordered import Running, range_placed, run_on

#: A conversation begins with the first turns of the one whose id is the multiple of GROUP at or below its own; how many is its checksum modulo HEADS.
GROUP, HEADS = 5, 9
_NODE = ["depth", "k1", "k2"]


def turn_rows(conversations: DataFrame, hold: Scratch, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, i, h1, h2, bytes): each turn's place from 1, two hashes of role and text, and the text's UTF-8 bytes.

    Turns are ordered by turn (nulls first), then role, then the text's MD5. Places run on across
    range partitions, so no task needs all turns of a conversation; texts stay where they are read.
    """
    role, text = F.coalesce(named(role_col), F.lit("")), F.coalesce(named(text_col), F.lit(""))
    rows = conversations.select(
        named(id_col).cast("long").alias("conv_id"),
        named(turn_col).alias("turn"),
        role.alias("role"),
        F.md5(text.cast("binary")).alias("tie"),
        F.xxhash64(role, text).alias("h1"),
        F.xxhash64(text, F.lit(1), role).alias("h2"),
        F.octet_length(text).cast("long").alias("bytes"),
    ).filter("conv_id is not null")
    placed = range_placed(rows, [F.col(c) for c in ("conv_id", "turn", "role", "tie")], "trie-turns", hold)
    return run_on(placed, 1, {"i": Running(F.lit(1))}).select("conv_id", "i", "h1", "h2", "bytes")


def rebuild(turns: DataFrame, hold: Scratch, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (conv_id, depth, h1, h2, bytes, length) and all conversations (conv_id, length), turnless ones included."""
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    first = turns.filter((F.col("i") < heads) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "base")
    known = first.groupBy("base").agg(F.count("*").alias("n_base"))
    convs = turns.groupBy("conv_id").agg(F.max("i").alias("n")).withColumns({"h": head, "base": F.col("conv_id") - F.col("conv_id") % group})
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = convs.join(known, "base", "left").withColumn("k", taken)
    convs = hold(convs.select("conv_id", "base", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-conversations")
    own = turns.filter(F.col("i") > head).join(convs.drop("base"), "conv_id").withColumn("depth", F.col("k") + F.col("i") - F.col("h"))
    begun = first.join(convs, "base").filter("i <= h").withColumn("depth", F.col("i"))
    columns = ["conv_id", "depth", "h1", "h2", "bytes", "length"]
    return own.select(*columns).union(begun.select(*columns)), convs.select("conv_id", "length")


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the sorted, comma-joined ids. Ids are packed in parallel by ranges; one hash then reads a node's packs as a stream, as a hash of one text must be."""
    order = [*_NODE, "conv_id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
            ids = batch.column(3).to_pylist()
            starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)])
            packs = [",".join(map(str, ids[a:b])) for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]
            yield pa.RecordBatch.from_pydict({**{c: pa.array(keys[i][starts]) for i, c in enumerate(_NODE)}, "first": pa.array([ids[a] for a in starts], pa.int64()), "pack": pa.array(packs)})

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*[(c, pa.int64()) for c in _NODE], ("ends_sha256", pa.string())])
        key, h = None, None
        for batch in batches:
            out = []
            for *at, _, text in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if at == key:
                    h.update(b",")
                else:
                    if key is not None:
                        out.append((*key, h.hexdigest()))
                    key, h = at, hashlib.sha256()
                h.update(text.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, h.hexdigest()), strict=True))], schema)

    keys = "depth bigint, k1 bigint, k2 bigint"
    n = shuffle_partitions(ends.sparkSession)
    packed = ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(pack, f"{keys}, first bigint, pack string")
    return packed.repartition(n, *_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(digest, f"{keys}, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame, hold: Scratch) -> DataFrame:
    """One row per node of the trie of ``turns`` (as :func:`rebuild` gives them) over all ``conversations``.

    A prefix is known by two 64-bit hashes that run on along its turns, each salted with its depth. Of
    a node's members the smallest id owns it; as a node's members are among its parent's, what a
    conversation owns of its path is everything from some depth on. So a member's share of what a
    subtree saves is the bytes between the node and where it begins to own, and one sum by prefix
    gives savings, children (members that own the next node) and leaves (members that own a childless
    end).
    """
    salted = {"x1": F.xxhash64("depth", "h1", "h2"), "x2": F.xxhash64("h2", "depth", "h1")}
    placed = range_placed(turns.withColumns(salted), [F.col("conv_id"), F.col("depth")], "trie-rebuilt", hold)
    along = run_on(placed, 1, {"k1": Running(F.col("x1"), "xor"), "k2": Running(F.col("x2"), "xor"), "upto": Running(F.col("bytes"))})
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = conversations.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("before"), zero.alias("upto"), "length")
    paths = along.select(
        "conv_id", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), (F.col("upto") - F.col("bytes")).alias("before"), "upto", "length"
    )
    paths = hold(paths.union(root), "trie-paths")
    owned = paths.groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id"), F.max("length").alias("deepest"), F.min("before").alias("before"))
    owners = owned.groupBy("conv_id").agg(F.min(F.struct("depth", "before")).alias("own"), F.max((F.col("depth") == F.col("deepest")).cast("int")).alias("leaf"))
    ends = paths.filter("depth = length")
    # Who owns nothing is a copy, or the beginning of another one: all its bytes are saved.
    members = ends.select("conv_id", "upto").join(owners, "conv_id", "left").select(
        "conv_id", F.coalesce("own.depth", F.lit(1 << 60)).alias("from"), F.coalesce("own.before", "upto").alias("saves"), F.coalesce("leaf", F.lit(0)).alias("leaf")
    )
    child = (F.col("depth") < F.col("length")) & (F.col("depth") + 1 >= F.col("from"))
    nodes = paths.join(members, "conv_id").groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
        F.count("*").alias("n_convs"),
        F.sum(child.cast("long")).alias("n_children"),
        F.sum("leaf").cast("long").alias("n_leaves"),
        F.sum(F.greatest(F.col("saves") - F.col("before"), F.lit(0))).alias("saved_tokens"),
    )
    nodes = hold(nodes, "trie-nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(parents, ["depth", "p1", "p2"], "left").join(_end_hashes(ends), _NODE, "left")
    ended = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return materialize(found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ended.alias("ends_sha256")), "trie")


def conversation_trie(conversations: DataFrame, group: int = GROUP, heads: int = HEADS, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations.

    A null role or text is an empty one; null turns come first; turns of one number go by role, then
    by the text's MD5, and a repeated row is a turn of its own. Rows without a conversation id belong
    to none and are left out. Long texts count by their bytes, long conversations by their turns, and
    neither is held by one task. A conversation that has no turns once rebuilt is a member of the root.
    An empty table has no nodes. Other columns are not read.
    """
    with Scratch(conversations.sparkSession) as hold:
        turns = hold(turn_rows(conversations, hold, id_col, turn_col, role_col, text_col), "trie-places")
        return prefix_trie(*rebuild(turns, hold, group, heads), hold)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations``; see :func:`conversation_trie`."""
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


#: The trie node by node: what a node's descendants save is found by climbing from each of them.
SQL = r"""
WITH RECURSIVE tbl AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))),
turns AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS i FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 5 AS b, (xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
  lambda a, x: xor(a >> 8, t[((xor(a, x) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) % 9)::BIGINT AS h FROM (SELECT DISTINCT c FROM turns), tbl),
rows_ AS (SELECT turns.c, 1 AS part, i, role, text FROM turns JOIN convs ON turns.c = convs.c WHERE i > h
  UNION ALL SELECT convs.c, 0, i, role, text FROM convs JOIN turns ON turns.c = b AND i <= h),
rebuilt AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d, octet_length(encode(text)) AS bytes, md5(role) || md5(text) AS turn FROM rows_),
keyed AS (SELECT c, d, bytes, md5(string_agg(turn, '') OVER (PARTITION BY c ORDER BY d)) AS key FROM rebuilt),
paths AS (SELECT c, d, bytes, key, coalesce(lag(key) OVER (PARTITION BY c ORDER BY d), '') AS parent FROM keyed UNION ALL SELECT c, 0, 0, '', NULL FROM convs),
lens AS (SELECT c, max(d) AS len FROM paths GROUP BY c),
nodes AS (SELECT key, d, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved, max(len) = d AS leaf,
  coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len = d), '') AS ends FROM paths JOIN lens USING (c) GROUP BY key, d),
up(top, key) AS (SELECT key, key FROM nodes UNION ALL SELECT n.parent, up.key FROM up JOIN nodes n ON n.key = up.top WHERE n.d > 0),
sums AS (SELECT top AS key, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (leaf) AS n_leaves FROM up JOIN nodes USING (key) GROUP BY 1),
kids AS (SELECT parent AS key, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums ON n.key = sums.key LEFT JOIN kids ON n.key = kids.key LEFT JOIN nodes p ON n.d > 0 AND p.key = n.parent
"""
