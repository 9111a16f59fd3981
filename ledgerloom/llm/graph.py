"""Connected components of large link tables, and links inside buckets of alike rows."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Members of a bucket that one task compares with as many others.
CHUNK = 8192
#: Members from which on a bucket is dealt anew into smaller ones, where the caller knows how.
FINER = 1024
#: Under which ``close`` finds the bucket of every row.
BUCKET = "_bucket"


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a long, b long)``; root is the least node reachable.

    Alternating large-star and small-star rounds: each replaces a node's links by
    links to the least neighbour, so a node with very many neighbours is combined
    before the shuffle. Every round is cut by a reliable checkpoint.
    """
    edges = cut_lineage(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    )
    before = None
    while (state := _state(edges)) != before:
        before = state
        upward = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        both = edges.unionByName(upward)
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = upward.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Every node's own least neighbour is kept; the other links move down to it.
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(lowest.select("u", F.col("m").alias("v")).unionByName(moved).distinct())
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Number and order-free hash of the links: equal once a round changes nothing."""
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), digest).first())


def _linked(
    values: dict[str, np.ndarray],
    group: np.ndarray,
    may_meet: Callable[[np.ndarray, np.ndarray], np.ndarray],
    close: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray],
    nodes: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal ``group``: rows are compared with those 1, 2, ... places on.

    Rows that are joined already, over any number of links, need no comparison, so alike
    rows cost about one comparison each. What comes back are the places of every joined
    row and of the least node it is joined to.
    """
    changes = np.flatnonzero(np.diff(group)) + 1
    ends = np.repeat(np.append(changes, len(group)), np.diff(np.concatenate([[0], changes, [len(group)]])))
    parent = np.arange(len(group))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    rows, step = np.arange(len(group)), 1
    while len(rows := rows[rows + step < ends[rows]]):
        others = rows + step
        open_pairs = (parent[rows] != parent[others]) & may_meet(rows, others)
        left, right = rows[open_pairs], others[open_pairs]
        good = close(values, left, right)
        for i, j in zip(left[good].tolist(), right[good].tolist()):
            a, b = top(i), top(j)
            # The least node names the tree, so trees of several buckets agree on it.
            if nodes[a] < nodes[b]:
                a, b = b, a
            parent[a] = b
        if good.any():
            while (parent[parent] != parent).any():
                parent = parent[parent]
        step += 1
    joined = np.flatnonzero(parent != np.arange(len(group)))
    return joined, parent[joined]


def bucket_links(
    members: DataFrame,
    bucket: str,
    node: str,
    columns: list[str],
    close: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray],
    finer: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(a, b): links that join the members of a bucket as all pairs for which ``close`` holds do.

    Each joined member is linked to the least node of its tree.

    ``members`` has ``bucket`` (long), ``node`` (long, distinct within a bucket) and
    ``columns``. ``close(values, left, right)`` says for pairs of places whether
    they are linked. Every pair of a bucket that is not joined yet is looked at by some
    task. Buckets of up to ``CHUNK`` members are worked through where counting them has
    put them; a larger one is cut into chunks and each pair of chunks is a group of its
    own, so no task holds more than two chunks of one bucket and no pair that fails is
    ever written. ``finer`` may deal the members of buckets of more than ``FINER`` into smaller
    buckets, in which every pair that is linked must meet; only what is large even then is cut.
    """
    names = list(dict.fromkeys([node, *columns]))
    within = Window.partitionBy(bucket)
    most = min(FINER, CHUNK) if finer else CHUNK
    sized = members.select(bucket, *names).withColumn("_n", F.count(F.lit(1)).over(within)).filter("_n > 1")
    whole = sized.filter(F.col("_n") <= most).select(
        bucket, F.lit(0).alias("_low"), F.lit(0).alias("_high"), F.lit(0).alias("_mine"), *names
    )
    large = sized.filter(F.col("_n") > most)
    placed = large.withColumn("_chunks", F.ceil(F.col("_n") / CHUNK).cast("int"))
    # A chunk meets itself and every other chunk once.
    met = F.transform(
        F.sequence(F.lit(0), F.col("_chunks") - 1),
        lambda other: F.struct(F.least("_mine", other).alias("low"), F.greatest("_mine", other).alias("high")),
    )
    group = [bucket, "_low", "_high"]
    chunk = F.pmod(F.xxhash64(node), F.col("_chunks")).cast("int")
    spread = placed.withColumn("_mine", chunk).withColumn("_met", F.explode(met)).select(
        bucket, F.col("_met.low").alias("_low"), F.col("_met.high").alias("_high"), "_mine", *names
    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None

        def links_of(table: pa.Table) -> pa.RecordBatch:
            values = {c: table.column(c).to_numpy() if pa.types.is_primitive(table.schema.field(c).type) else np.array(table.column(c).to_pylist(), object) for c in names}
            keys = [table.column(c).to_numpy() for c in group]
            values[BUCKET] = keys[0]
            changed = np.zeros(len(table), bool)
            for key in keys:
                changed[1:] |= key[1:] != key[:-1]
            mine, one = table.column("_mine").to_numpy(), keys[1] == keys[2]
            left, right = _linked(values, np.cumsum(changed), lambda i, j: one[i] | (mine[i] != mine[j]), close, values[node])
            return pa.record_batch({"a": pa.array(values[node][left], pa.int64()), "b": pa.array(values[node][right], pa.int64())})

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if waiting is not None:
                table = pa.concat_tables([waiting, table])
            last = [table.column(c)[-1].as_py() for c in group]
            same = np.ones(len(table), bool)
            for c, value in zip(group, last):
                same &= table.column(c).to_numpy() == value
            start = int(np.argmax(same))
            if start:
                yield links_of(table.slice(0, start).combine_chunks())
            waiting = table.slice(start).combine_chunks()
        if waiting is not None:
            yield links_of(waiting)

    # The smaller buckets lie sorted after the count, so this sort costs them nothing.
    links = whole.sortWithinPartitions(bucket).mapInArrow(link, "a long, b long")
    if finer:
        return links.unionByName(bucket_links(finer(large.select(bucket, *names)), bucket, node, columns, close))
    dealt = spread.repartition(*[F.col(c) for c in group])
    return links.unionByName(dealt.sortWithinPartitions(*group).mapInArrow(link, "a long, b long"))


def near_prints(radius: int) -> Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray]:
    """Linked if the 64-bit values of column ``print`` differ in at most ``radius`` bits."""

    def close(values: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
        prints = values["print"].view(np.uint64)
        return np.bitwise_count(prints[left] ^ prints[right]) <= radius

    return close
