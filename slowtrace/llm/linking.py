"""Links between items that share postings, without rows for everybody with everybody in a posting list.

A list of ``n`` items first yields ``n - 1`` pairs: everybody with the list's centre. Verified pairs give provisional
groups. A pair that was left out matters only if it would join two groups; both its items were paired with the centre of a
list they share. So the second step looks, for each centre whose items are in several groups, for links between
the groups. It does so in blocks of bounded size, each pair of blocks in a task of its own, and yields one link for two
groups that meet. A large group of alike items costs its size in rows, not its square, and no link that could connect
two groups is lost.

Blocks of a long list whose items are in many groups would meet each other too often. Where the caller knows finer keys,
of which linked items share one too, such a list is taken apart by them first and both steps are done on its parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slowtrace.llm.key_filter import KeyFilter
from slowtrace.session import settle

BLOCK = 256
LONG = 4 * BLOCK  # a list of more items in several groups is taken apart

Verify = Callable[[DataFrame], DataFrame]
Plausible = Callable[[str, str], Column]
Matches = Callable[[pa.Table, pa.Table], np.ndarray]
Finer = Callable[[DataFrame], DataFrame]


def shared_postings(postings: DataFrame) -> DataFrame:
    """Postings (key, node) whose key has several, with their number ``n``.

    Most keys are met once; a filter of fixed size leaves them out before the join.
    """
    shared = settle(postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    some = KeyFilter(shared, "key")
    return postings.where(some.passes("key")).join(shared, "key")


def centred(postings: DataFrame) -> DataFrame:
    """(centre, node): every node with the centre, the node of least ``rank``, of each list it is in."""
    centre = (postings.groupBy("key").agg(F.min(F.struct("rank", "node")).alias("centre"), F.count("*").alias("n"))
              .where("n > 1").select("key", F.col("centre.node").alias("centre")))
    return postings.join(centre, "key").select("centre", "node").distinct()


def star_pairs(around: DataFrame, nodes: DataFrame, plausible: Plausible) -> DataFrame:
    """Pairs (a, b), a < b, of a centre and a node around it that may be linked, by the columns of ``nodes``."""
    pairs = around.where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    left, right = nodes.alias("l"), nodes.alias("r")
    return (pairs.distinct().join(left, F.col("a") == F.col("l.node")).join(right, F.col("b") == F.col("r.node"))
            .where(plausible("l", "r")).select("a", "b"))


def _placed(lists: DataFrame, groups: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """``lists`` with the group of each node, and (``by``, n) of the lists whose ``n`` nodes are in several groups."""
    placed = lists.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = (placed.groupBy(by).agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                    F.count("*").alias("n")).where("low < high").select(by, "n"))
    return placed, mixed


def crossing_links(around: DataFrame, groups: DataFrame, payload: Callable[[DataFrame], DataFrame], matches: Matches) -> DataFrame:
    """Links (a, b) between nodes around one centre that are in different groups of ``groups`` (node, component).

    ``payload(nodes)`` gives (node, ...) what ``matches`` needs to tell which rows of two tables are linked.
    """
    placed, mixed = _placed(around, groups, "centre")
    split = mixed.select("centre", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    open_ = settle(placed.join(split, "centre")
                   .withColumn("block", F.pmod(F.xxhash64("component", "node"), F.col("blocks"))))
    met = (open_.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
           .select("centre", "node", "component", "block", F.least("block", "other").alias("low"),
                   F.greatest("block", "other").alias("high")))

    def compared(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        block, low, high = rows["block"].to_numpy(), key[1].as_py(), key[2].as_py()
        left = rows.filter(pa.array(block == low))
        right = left if low == high else rows.filter(pa.array(block == high))
        one, two = left["component"].to_numpy(), right["component"].to_numpy()
        i, j = np.nonzero(matches(left, right) & (one[:, None] != two[None, :]))
        _, first = np.unique(np.stack([one[i], two[j]], axis=1), axis=0, return_index=True)
        i, j = i[first], j[first]
        yield pa.RecordBatch.from_arrays([left["node"].take(pa.array(i)).combine_chunks(),
                                          right["node"].take(pa.array(j)).combine_chunks()], ["a", "b"])

    carried = payload(open_.select("node").distinct())
    return (met.join(carried, "node").groupBy("centre", "low", "high").applyInArrow(compared, "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b): the smallest node that can be reached.

    Alternates two steps on settled edge tables: every node hands its larger neighbours to its smallest one, then its
    smaller neighbours. Edges never grow in number and become stars in a logarithmic number of rounds.
    """
    edges = settle(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.join(smallest, "a").where("b > a").select(F.col("m").alias("a"), "b")
                 .where("a <> b").distinct())
        smaller = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (large.join(smaller, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
                 .union(smaller.select(F.col("m").alias("a"), "b")).where("a <> b").distinct())
        edges = settle(small)
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def linked_groups(postings: DataFrame, plausible: Plausible, verify: Verify, payload: Callable[[DataFrame], DataFrame],
                  matches: Matches, nodes: DataFrame | None = None, finer: Finer | None = None) -> DataFrame:
    """(node, component) of nodes that share a key of ``postings`` (key, node, rank, ...) and are linked.

    ``verify`` keeps the linked ones of pairs (a, b); ``plausible`` says from the columns of two rows of ``nodes``, or
    else from other columns of two postings, whether a pair need be verified. ``payload`` and ``matches`` decide the same for blocks of nodes.
    ``finer(nodes)`` gives other postings (key, node, rank) of some nodes, under which all linked ones of them meet.
    """
    around = settle(centred(postings))
    nodes = postings.drop("key").dropDuplicates(["node"]) if nodes is None else nodes
    links = settle(verify(star_pairs(around, nodes, plausible)))
    if finer is not None:
        groups = components(links)
        placed, mixed = _placed(around, groups, "centre")
        long = settle(mixed.where(F.col("n") > LONG).select("centre"))
        if not long.isEmpty():
            fine = settle(finer(placed.join(long, "centre").select("node").distinct()))
            several = _placed(fine, groups, "key")[1].select("key")
            parts = settle(centred(fine.join(several, "key")))
            links = settle(links.union(verify(star_pairs(parts, nodes, plausible))))
            around = around.join(long, "centre", "left_anti").union(parts)
    more = settle(crossing_links(around, components(links), payload, matches))
    return components(links.union(more))
