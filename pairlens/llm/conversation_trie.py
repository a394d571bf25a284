"""Prefix trie of conversations by preorder intervals.

Every conversation is the list of its turns' digests. Sorted, distinct lists give an
order in which each node's conversations are a run, so a node is known by the first
and the last list that pass it. Nodes in the order (first list, depth) are in
preorder, and the subtree of a node ends where the new nodes of its last list end.
Running sums of nodes, leaves and savings over that order are made within range
partitions and shifted by the sums of those before; what a subtree holds is the
difference of two of them. Digests are MD5 of 128 bits; a node's name is the chain
of its turns' digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import bound_batches, cut, tidy

ROOT = hashlib.md5(b"").digest()
#: Bytes of a row of joined ids.
CHUNK = 1 << 16
#: A parent with at least one in so many nodes below it is broadcast: there are at most so many.
COMMON = 2000


def conversation_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, own): each conversation's turns (key, len), ordered by turn, null first, then by digest.

    Null roles and texts are empty; ``len`` is in code points. Rows without a conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), key.alias("key"), F.length(text).cast("long").alias("len")).alias("x"))
    # a conversation is dealt with the one its beginning may come from
    dealt = rows.repartition((F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    made = dealt.groupBy((F.col("conv_id") - F.col("conv_id") % 100).alias("base"), "conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return made.select("base", "conv_id", F.transform("x", lambda x: F.struct(x["key"].alias("key"), x["len"].alias("len"))).alias("own"))


def rebuilt(own: DataFrame) -> DataFrame:
    """(conv_id, turns): the first h turns of conversation c - c % 100, then c's own after its first h; h = crc32(c) % 6."""
    first = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, 5)), ignorenulls=True).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    turns = F.concat(F.slice(F.coalesce(F.col("start"), F.slice("own", 1, 0)), F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0))))
    return own.select("conv_id", "own", first.alias("start"), h.alias("h")).select("conv_id", turns.alias("turns"))


def chain(keys: list[bytes]) -> Iterator[bytes]:
    """Names of the nodes of a path, the root first."""
    at = ROOT
    yield at
    for key in keys:
        at = hashlib.md5(at + key).digest()
        yield at


@tidy
def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the name of the node where each conversation ends."""
    for batch in batches:
        names = []
        for keys in batch.column("keys").to_pylist():
            for name in chain(keys):
                pass
            names.append(name)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.binary())], [*batch.schema.names, "path"])


@tidy
def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(list, node, parent, depth, len, n, conv_id): a row for each node that a list passes."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            some = batch.slice(lo, 256)
            row, node, parent, depth, size = [], [], [], [], []
            for i, (keys, lens) in enumerate(zip(some.column("keys").to_pylist(), some.column("lens").to_pylist(), strict=True)):
                names = list(chain(keys))
                row += [i] * len(names)
                node += names
                parent += [None, *names[:-1]]
                depth += range(len(names))
                size += [0, *lens]
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([some.column("list").take(take), pa.array(node, pa.binary()), pa.array(parent, pa.binary()), pa.array(depth, pa.int64()), pa.array(size, pa.int64()), some.column("n").take(take), some.column("conv_id").take(take)], ["list", "node", "parent", "depth", "len", "n", "conv_id"])


def running_sums(df: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """df with ``to_<v>`` for each long column v: its sum over all rows up to this one in an order without ties.

    Sums run within range partitions; one row a partition goes to the driver to shift them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = dict.fromkeys(values, 0)
        for batch in batches:
            made = []
            for v in values:
                sums = np.cumsum(batch.column(v).to_numpy(zero_copy_only=False).astype(np.int64)) + carry[v]
                carry[v] = int(sums[-1]) if len(sums) else carry[v]
                made.append(pa.array(sums, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *(f"to_{v}" for v in values)])

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    shape = ", ".join(f"`{n}` {t}" for n, t in dealt.dtypes) + "".join(f", to_{v} long" for v in values)
    made = cut(dealt.mapInArrow(run, shape))
    before, shifts = dict.fromkeys(values, 0), []
    for row in made.groupBy("part").agg(*[F.sum(v).alias(v) for v in values]).orderBy("part").collect():
        shifts.append((row["part"], *before.values()))
        before = {v: before[v] + row[v] for v in values}
    shift = df.sparkSession.createDataFrame(shifts, "part int" + "".join(f", by_{v} long" for v in values))
    summed = made.join(F.broadcast(shift), "part")
    return summed.select(*df.columns, *[(F.col(f"to_{v}") + F.col(f"by_{v}")).alias(f"to_{v}") for v in values])


@tidy
def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, conv_id), sorted, to (path, least id, ids joined by commas) of at most about CHUNK bytes."""

    def row(path: bytes, ids: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([int(ids[0])], pa.int64()), pa.array([",".join(ids)], pa.string())], ["path", "least", "ids"])

    path, ids, size, done = None, [], 0, []
    for batch in batches:
        for p, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (p != path or size >= CHUNK):
                done.append(row(path, ids))
                ids, size = [], 0
            path = p
            ids.append(str(i))
            size += len(ids[-1]) + 1
            if len(done) >= 1000:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                done = []
    if ids:
        done.append(row(path, ids))
    if done:
        yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]


@tidy
def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (path, least, ids) to (path, ends_sha256), holding one row at a time."""
    path, digest, names, out = None, None, [], []
    for batch in batches:
        for p, ids in zip(batch.column("path").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if p != path:
                if path is not None:
                    names.append(path)
                    out.append(digest.hexdigest())
                path, digest = p, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(out, pa.string())], ["path", "ends_sha256"])
        names, out = [], []
    if path is not None:
        yield pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([digest.hexdigest()], pa.string())], ["path", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(path, ends_sha256): the SHA-256 of each path's conv_ids, ascending, joined by commas. A path's ids are joined where they lie, over as many tasks as they fill, and hashed from pieces of CHUNK bytes."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = ends.select("path", "conv_id").repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(_joined, "path binary, least long, ids string")
    return joined.repartition("path").sortWithinPartitions("path", "least").mapInArrow(_digested, "path binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, position, end_position): one row a node.

    ``conversations`` has conv_id, each once, and turns, an array of (key, len);
    an empty array is a conversation of the root alone. conv_id names a node's
    smallest member, parent_conv_id its parent's (root: null). n_leaves counts nodes
    without children in the subtree, the node itself included; saved_tokens sums
    (members - 1) * len over it. Positions are preorder numbers from 1, and a
    subtree is position..end_position. Without conversations there is no root and no row.
    """
    bound_batches(conversations.sparkSession)
    shaped = conversations.select("conv_id", F.col("turns.key").alias("keys"), F.col("turns.len").alias("lens"))
    named = cut(shaped.mapInArrow(_ends, "conv_id long, keys array<binary>, lens array<long>, path binary"))
    lists = named.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.first("keys").alias("keys"), F.first("lens").alias("lens"))
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut(lists.repartitionByRange(parts, "keys").sortWithinPartitions("keys").withColumn("list", F.monotonically_increasing_id()))
    steps = ordered.mapInArrow(_steps, "list long, node binary, parent binary, depth long, len long, n long, conv_id long")
    nodes = steps.groupBy("node").agg(F.min("list").alias("first"), F.max("list").alias("last"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), *[F.first(c).alias(c) for c in ("parent", "depth", "len")])
    nodes = cut(nodes)
    total = nodes.count()
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    common = F.col("n_children") * COMMON >= max(total, 1)
    above = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), common.alias("common"))
    hot, rest = F.broadcast(above.where("common").drop("common")), above.where("NOT common").drop("common")
    below = nodes.where("parent IS NOT NULL")
    placed = below.join(hot, "parent").unionByName(below.join(hot, "parent", "left_anti").join(rest, "parent")).unionByName(nodes.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")))
    valued = placed.select("node", "first", "last", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", F.lit(1).cast("long").alias("nodes"), (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("len")).alias("saved"))
    summed = running_sums(valued, ["first", "depth"], ["nodes", "leaves", "saved"])
    to_end = summed.groupBy(F.col("first").alias("last")).agg(*[F.max_by(f"to_{v}", "depth").alias(f"end_{v}") for v in ("nodes", "leaves", "saved")])
    within = lambda v: F.col(f"end_{v}") - F.col(f"to_{v}") + F.col(v)
    whole = summed.join(to_end, "last").select("node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", within("leaves").alias("n_leaves"), within("saved").alias("saved_tokens"), F.col("to_nodes").alias("position"), F.col("end_nodes").alias("end_position"))
    ends = ends_digests(named.select("path", "conv_id")).withColumnRenamed("path", "node")
    none = F.lit(hashlib.sha256().hexdigest())
    return whole.join(ends, "node", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"), "position", "end_position")


def conversation_trie(turns: DataFrame) -> DataFrame:
    """prefix_trie of the rebuilt conversations of a table (conv_id, turn, role, text).

    Turns are ordered by turn, null first; equal turns by the digest of role and
    text, so repeated rows follow each other. Null roles and texts are empty; rows
    without a conv_id belong to no conversation. Texts of any length are read once
    and travel as digests; a conversation's digests are one row. An empty table
    gives no rows. Other columns are ignored, whatever their names.
    """
    return prefix_trie(rebuilt(conversation_turns(turns)))
