"""Shards of equal row counts by balanced label propagation.

Documents with equal texts are linked.  They start scattered over the shards by a
hash, in proportion to the room there.  What starts in one shard and is alike stays
together, so the propagation's state is a row per group and starting shard, a cell,
with its current shard and a count.  In each round every cell looks at where its
neighbours are now and asks to go to the shard that holds most of them.  The rows
that ask are added up by shards and by slices of a hash (a bounded table), and the
driver admits whole slices as far as every shard's quota (and SLACK) allows, counting
what leaves as room.  Shards that had to refuse cells are closed in the next round, so
that these cells try the best of the others; cells that stay refused stay where they
are.  A round without a wish ends the propagation.

Groups larger than a shard, of which there can only be as many as shards, come
before: they fill whole shards one after another and leave the rest of the quotas
to the propagation.  Then rows are placed exactly: a shard takes the documents of
its cells, in order, up to its quota; what is beyond the quota goes on, in order, to
shards with room, and documents without links fill what is left.  Row counts of any
two shards differ by one at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomrank.llm import scratch

ROUNDS = 8
#: By how much a shard may exceed its quota during the propagation: without it full shards couldn't even swap.
SLACK = 0.1
#: Slices of a hash that are admitted or refused whole.
SLICES = 64
_GROUP = ("g1", "g2")


def _start(room: np.ndarray) -> Column:
    """A shard for every document by a hash of its id, in proportion to the shards' room."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, int(room.sum()))))
    return F.least(F.size(F.filter(_literal(np.cumsum(room)), lambda end: end <= at)), F.lit(len(room) - 1)).cast("int")


def admitted(wanted: np.ndarray, size: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many slices of the wishes (from, to, slice) come true, and which shards refused some.

    No shard ends above its room, unless it was above before and gets nothing.
    """
    many = np.full(wanted.shape[:2], wanted.shape[2])
    upto = np.concatenate([np.zeros((*wanted.shape[:2], 1)), np.cumsum(wanted, axis=2)], axis=2)
    rows, columns = np.indices(many.shape)
    refused = np.zeros(len(size), bool)
    while True:
        moved = upto[rows, columns, many]
        over = size - moved.sum(1) + moved.sum(0) - room
        late = np.flatnonzero((over > 0) & (moved.sum(0) > 0))
        if not len(late):
            return many, refused
        for to in late:
            refused[to] = True
            left = over[to]
            for source in np.argsort(-moved[:, to], kind="stable"):
                while left > 0 and many[source, to] > 0:
                    many[source, to] -= 1
                    left -= wanted[source, to, many[source, to]]


def propagated(state: DataFrame, many: DataFrame, room: np.ndarray, rounds: int = ROUNDS) -> DataFrame:
    """(g1, g2, start, home): the shard of every cell of the groups in `many` after label propagation."""
    shards = len(room)
    cells = scratch.saved(state.join(many, list(_GROUP), "left_semi").groupBy(*_GROUP, "start").agg(F.count("*").alias("n")).withColumn("shard", F.col("start")), "cells")
    closed = np.zeros(shards, bool)
    for turn in range(rounds):
        there = cells.groupBy(*_GROUP, "shard").agg(F.sum("n").alias("near"))
        order = F.struct("near", F.pmod(F.xxhash64(*_GROUP) + F.col("shard"), F.lit(shards)).alias("tie"))
        best = there.withColumn("order", order).groupBy(*_GROUP).agg(
            F.max(F.when(~F.col("shard").isin(np.flatnonzero(closed).tolist()), F.struct("order", "shard"))).alias("best"), F.map_from_entries(F.collect_list(F.struct("shard", "order"))).alias("now")
        )
        asked = cells.join(best, list(_GROUP))
        better = F.coalesce(F.col("best.order") > F.element_at("now", F.col("shard")), F.lit(False))  # most of the neighbours, by a common order
        asked = asked.select(*_GROUP, "start", "n", "shard", F.when(better, F.col("best.shard")).otherwise(F.col("shard")).alias("label"))
        asked = scratch.saved(asked.withColumn("slice", F.pmod(F.xxhash64(*_GROUP, F.lit(turn)), F.lit(SLICES)).cast("int")), "asked")
        wanted, size = np.zeros((shards, shards, SLICES)), np.zeros(shards)
        for r in asked.groupBy("shard", "label", "slice").agg(F.sum("n").alias("n")).toLocalIterator():  # at most shards x shards x SLICES rows
            size[r["shard"]] += r["n"]
            if r["shard"] != r["label"]:
                wanted[r["shard"], r["label"], r["slice"]] += r["n"]
        if not wanted.any():
            scratch.drop(asked)
            if not closed.any():
                break
            closed[:] = False
            continue
        slices, closed = admitted(wanted, size, np.floor(room * (1 + SLACK)))
        goes = F.col("slice") < F.element_at(_literal(slices.reshape(-1)), F.col("shard") * shards + F.col("label") + 1)
        after = scratch.saved(asked.select(*_GROUP, "start", "n", F.when(goes, F.col("label")).otherwise(F.col("shard")).alias("shard")), "cells")
        scratch.drop(cells)
        scratch.drop(asked)
        cells = after
    return cells.select(*_GROUP, "start", F.col("shard").alias("home"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task's number and each row's place among the task's rows of its home."""
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        home = batch.column("home").to_numpy(zero_copy_only=False)
        place = np.zeros(len(home), np.int64)
        for h in np.unique(home):
            mine = np.flatnonzero(home == h)
            place[mine] = seen.get(int(h), 0) + np.arange(len(mine))
            seen[int(h)] = seen.get(int(h), 0) + len(mine)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "size", "text_crc32", "home")), pa.array(np.full(len(home), part, np.int32)), pa.array(place)], ["doc_id", "size", "text_crc32", "home", "part", "place"])


def _literal(x: np.ndarray) -> Column:
    return F.array(*(F.lit(int(v)).cast("long") for v in x))


def sharded(docs: DataFrame, shards: int = 16, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    A null text counts as empty, and all empty texts are one group.  Rows that
    repeat are placed as often; a table with fewer rows than shards leaves shards
    empty.  The law is `rows`, so grown_shard is null.
    """
    text = F.coalesce("text", F.lit(""))
    state = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text, F.lit(1)).alias("g1"), F.xxhash64(F.lit(2), text).alias("g2"),
    )
    state = scratch.saved(state, "state")
    total = state.count()
    quota = np.array([total // shards + (i < total % shards) for i in range(shards)], np.int64)
    groups = scratch.saved(state.groupBy(*_GROUP).agg(F.count("*").alias("m")).where("m > 1"), "groups")
    large = groups.where(F.col("m") > int(quota[0]))  # fewer than shards
    full = int(large.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0])
    taken = np.minimum(quota, np.maximum(0, full - (np.cumsum(quota) - quota)))
    state = state.withColumn("start", _start(quota - taken))
    home = propagated(state, groups.where(F.col("m") <= int(quota[0])).select(*_GROUP), quota - taken, rounds)
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("start")
    homes = scratch.saved(home.unionByName(large.select(*_GROUP, every, F.lit(shards + 1).alias("home"))), "homes")
    rows = state.join(homes, [*_GROUP, "start"], "left").withColumn("home", F.coalesce("home", F.lit(shards)))
    # a task's rows: a range of (home, group, doc_id), so that one large group is many ranges
    tasks = max(1, -(-total // 200_000), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["home", *_GROUP, "doc_id"]
    rows = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    placed = scratch.saved(rows.select("doc_id", "size", "text_crc32", "home").mapInArrow(_numbered, "doc_id long, size long, text_crc32 long, home int, part int, place long"), "placed")
    parts = scratch.saved(placed.groupBy("home", "part").agg(F.count("*").alias("n")), "parts")
    before = Window.partitionBy("home").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("home", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), "n")
    counts = np.zeros(shards + 2, np.int64)
    for r in placed.groupBy("home").agg(F.count("*").alias("n")).collect():
        counts[r["home"]] = r["n"]
    stay = np.minimum(counts[:shards], quota - taken)
    excess = np.append(counts[:shards] - stay, [0, 0])
    pool_from = np.cumsum(excess) - excess  # where each home's excess begins in the pool; those without links come last
    room = quota - taken - stay
    rank, at = F.col("before") + F.col("place"), F.col("home") + 1
    own = (F.col("home") < shards) & (rank < F.element_at(_literal(np.append(stay, [0, 0])), at))
    pool = F.element_at(_literal(pool_from), at) + rank - F.element_at(_literal(np.append(stay, [0, 0])), at)
    named = placed.join(parts.drop("n"), ["home", "part"]).select("doc_id", "size", "text_crc32", "home", rank.alias("rank"), own.alias("own"), pool.alias("pool"))

    def filled(spaces: np.ndarray, before: np.ndarray, nth: str) -> tuple[Column, Column]:
        """Shard and slot of the nth row that goes to the spaces behind what is there before."""
        ends = np.cumsum(spaces)
        to = F.least(F.size(F.filter(_literal(ends), lambda x: x <= F.col(nth))), F.lit(shards - 1))
        return to, F.element_at(_literal(before - (ends - spaces)), to + 1) + F.col(nth)

    large_to, large_slot = filled(taken, np.zeros_like(taken), "rank")
    pool_to, pool_slot = filled(room, taken + stay, "pool")
    is_large = F.col("home") == shards + 1
    shard = F.when(is_large, large_to).when(F.col("own"), F.col("home")).otherwise(pool_to).cast("int")
    slot = F.when(is_large, large_slot).when(F.col("own"), F.element_at(_literal(taken), F.least("home", F.lit(shards - 1)) + 1) + F.col("rank")).otherwise(pool_slot)
    return named.withColumn("shard", shard).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
