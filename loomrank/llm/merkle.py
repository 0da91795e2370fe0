"""A Merkle manifest of a table: one digest for all rows, one for each group, and a proof for every row.

A row's leaf is the digest of its fields.  Within a group leaves ascend by an order
column; runs of `fanout` nodes become their parent until one node is left, the
group's subroot.  The subroots, in the order of their groups, give the root alike.

Leaves are sorted by range, so that a partition holds whole stretches of groups.
Two passes run over the same sorted partitions.  The first counts each group's
leaves in each partition; with the counts before it a partition knows its leaves'
places and builds every subtree that lies within it.  Nodes whose parent reaches
into other partitions are few (less than two runs a level, group and partition);
they are shuffled by coordinate and finished level by level.  The second pass gets
the nodes that its partition lacks and returns the siblings on each leaf's way up.

No partition holds more than about `rows` leaves and no leaf carries its text, so
the size of groups and texts doesn't matter.  Digests are lower-case hex text.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomrank.llm import scratch

#: Leaves of a partition, about: Python holds them at once.
ROWS = 1 << 16
STEP = T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())])
_NODE = "grp string, level int, idx long, digest string, size long"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(column: Column) -> Column:
    """A value as it enters a leaf: its bytes' number, a colon and the value; a dash for null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*(field(c) for c in columns)), 256)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda at, step: F.sha2(F.concat(step["left"], at, step["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings, from the leaf's to those below the root."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def counts(size: int, fanout: int) -> list[int]:
    """Nodes on every level of a tree, leaves first."""
    out = [size]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


def _upwards(first: int, digests: list[str], size: int, fanout: int) -> list[tuple[int, list[str], int, int]]:
    """For each level the first complete node of a stretch of leaves, the complete nodes' digests, and the children that have a parent among the next level's (from, to)."""
    many, out, level = counts(size, fanout), [], 0
    while True:
        end = first + len(digests)
        if level + 1 == len(many):
            out.append((first, digests, first, first))
            return out
        a = -(-first // fanout)  # the first parent that begins within the stretch
        b = many[level + 1] if end == many[level] else end // fanout  # a last run may be short
        b = max(a, b)
        low, high = min(a * fanout, end), min(b * fanout, end)
        out.append((first, digests, low, max(low, high)))
        parents = [digest("".join(digests[i * fanout - first : (i + 1) * fanout - first])) for i in range(a, b)]
        if not parents:
            return out
        first, digests, level = a, parents, level + 1


def _stretches(rows: list[tuple]) -> Iterator[tuple[str | None, list[tuple]]]:
    for key, own in groupby(rows, key=lambda r: r[0]):
        yield key, list(own)


def _ragged(fanout: int):
    """Nodes of a partition whose parent isn't built in it, and the roots of trees that are."""

    def run(both: tuple[list[tuple], list[tuple]]) -> Iterator[tuple]:
        rows, beside = both
        place = {key: (at, size) for key, at, size in beside}
        for key, own in _stretches(rows):
            at, size = place[key]
            for level, (first, digests, low, high) in enumerate(_upwards(at, [r[1] for r in own], size, fanout)):
                for i, d in enumerate(digests, first):
                    if not low <= i < high:
                        yield key, level, i, d, size

    return run


def _wanted(runs: DataFrame, fanout: int) -> DataFrame:
    """part, grp, level and parent of all nodes that a stretch of leaves may need from elsewhere: the parents at its two ends."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out: list[tuple] = []
            for part, key, at, n, size in zip(*(batch.column(c).to_pylist() for c in ("part", "grp", "at", "n", "size")), strict=True):
                first, last = at, at + n - 1
                for level in range(len(counts(size, fanout)) - 1):
                    first, last = first // fanout, last // fanout
                    out += [(part, key, level, first)] + ([(part, key, level, last)] if last > first else [])
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "grp", "level", "parent"])

    return runs.mapInArrow(run, "part int, grp string, level int, parent long")


def _climbed(fanout: int):
    """Each leaf of a partition with its proof: the siblings left and right of its way, level by level, and the way above its root."""

    def run(both: tuple[list[tuple], list[tuple]]) -> Iterator[tuple]:
        rows, beside = both
        place, foreign = {}, defaultdict(dict)
        for key, at, size, nodes, root, above in beside:
            place[key] = (at, size, root, [tuple(step) for step in above or ()])
            for level, i, d in nodes or ():
                foreign[key, level][i] = d
        for key, own in _stretches(rows):
            at, size, root, above = place[key]
            many = counts(size, fanout)
            known = [dict(enumerate(digests, first)) for first, digests, *_ in _upwards(at, [r[1] for r in own], size, fanout)]
            known += [{} for _ in range(len(many) - len(known))]
            for level, nodes in enumerate(known):
                nodes.update(foreign[key, level])
            ways: dict[tuple[int, int], list[tuple[str, str]]] = {(len(many) - 1, 0): above}

            def way(level: int, i: int) -> list[tuple[str, str]]:
                if (level, i) not in ways:
                    nodes, low = known[level], i - i % fanout
                    step = "".join(nodes[j] for j in range(low, i)), "".join(nodes[j] for j in range(i + 1, min(low + fanout, many[level])))
                    out = [step, *way(level + 1, i // fanout)]
                    if level == 0:
                        return out  # a leaf's own: nothing shares it
                    ways[level, i] = out
                return ways[level, i]

            for i, row in enumerate(own, at):
                yield (*row, root, way(0, i))

    return run


def _beside(rows: RDD, table: DataFrame, columns: list[str]) -> RDD:
    """(rows, rows of the table with its number) of each partition; the few of the table are dealt to the partitions, not the rows."""
    dealt = table.select("part", *columns).rdd.map(lambda r: (r[0], tuple(r)[1:])).partitionBy(rows.getNumPartitions(), lambda p: p).values()
    more = dealt.getNumPartitions() - rows.getNumPartitions()
    if more > 0:  # numbers stay as they are
        rows = rows.union(rows.context.parallelize([], more))
    return rows.glom().zip(dealt.glom())


class Forest:
    """A tree for each group of a stored table with a column `leaf`; the other columns travel with the leaves.

    `order` must leave only the order of equal leaves in doubt.  nodes: what
    partitions left open, and all nodes above it.  roots: grp and root.
    """

    def __init__(self, leaves: DataFrame, group: str, order: list[str], fanout: int = 8, rows: int = ROWS):
        self.spark, self.fanout = leaves.sparkSession, fanout
        parts = max(1, -(-leaves.count() // rows))
        names = [c for c in leaves.columns if c not in (group, "leaf")]
        ranged = leaves.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order).select(F.col(group).alias("grp"), "leaf", *names)
        self.fields = ranged.schema.fields
        self.sorted = ranged.rdd.map(tuple)  # one plan and one shuffle: both passes and any retry see the same partitions

        def counted(part: int, own: Iterator[tuple]) -> Iterator[tuple]:
            for key, some in groupby(own, key=lambda r: r[0]):
                yield part, key, sum(1 for _ in some)

        found = scratch.saved(self.spark.createDataFrame(self.sorted.mapPartitionsWithIndex(counted), "part int, grp string, n long", verifySchema=False), "counts")
        own = Window.partitionBy("grp")
        before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        self.runs = scratch.saved(found.withColumns({"at": before, "size": F.sum("n").over(own)}), "runs")
        open_nodes = _beside(self.sorted, self.runs, ["grp", "at", "size"]).flatMap(_ragged(fanout))
        self.nodes = self._finished(scratch.saved(self.spark.createDataFrame(open_nodes, _NODE, verifySchema=False), "nodes"))
        top = F.ceil(F.col("size") / F.pow(F.lit(float(fanout)), F.col("level"))) == 1
        self.roots = self.nodes.where(top).select("grp", F.col("digest").alias("root"))

    def _finished(self, nodes: DataFrame) -> DataFrame:
        """The nodes and all above them, a level at a time."""
        most = self.runs.agg(F.max("size")).first()[0] or 0
        every, current = nodes, nodes.where("level = 0")
        for level in range(len(counts(most, self.fanout)) - 1 if most else 0):
            wide = F.ceil(F.col("size") / F.lit(self.fanout**level)) > 1  # else the group is done
            parent = F.floor(F.col("idx") / self.fanout).cast("long")
            children = F.array_sort(F.collect_list(F.struct("idx", "digest")))
            above = current.where(wide).groupBy("grp", parent.alias("idx"), "size").agg(children.alias("own"))
            joined = F.sha2(F.array_join(F.col("own.digest"), ""), 256).alias("digest")
            above = scratch.saved(above.select("grp", F.lit(level + 1).alias("level"), "idx", joined, "size"), "above")
            every = every.unionByName(above)
            current = above.unionByName(nodes.where(F.col("level") == level + 1))
        return every

    def proved(self, above: DataFrame | None = None) -> DataFrame:
        """grp, leaf, the other columns, root and proof, an array of (left, right); `above` (grp, above) has what follows a group's own way."""
        at = F.floor(F.col("idx") / self.fanout).cast("long").alias("parent")
        nodes = self.nodes.select("grp", "level", at, "idx", "digest").alias("e")
        given = _wanted(self.runs.where("size > n"), self.fanout).alias("w").join(nodes, F.expr("w.grp <=> e.grp AND w.level = e.level AND w.parent = e.parent"))
        given = given.groupBy("w.part", "w.grp").agg(F.collect_list(F.struct("w.level", "e.idx", "e.digest")).alias("nodes")).alias("g")
        ways = self.roots.withColumn("above", F.lit(None).cast(T.ArrayType(STEP))) if above is None else self.roots.alias("o").join(above.alias("a"), F.expr("o.grp <=> a.grp")).select("o.grp", "root", "above")
        beside = self.runs.alias("r").join(given, F.expr("r.part = g.part AND r.grp <=> g.grp"), "left").join(ways.alias("y"), F.expr("r.grp <=> y.grp"))
        beside = scratch.saved(beside.select("r.part", "r.grp", "r.at", "r.size", "g.nodes", "y.root", "y.above"), "siblings")
        kind = T.StructType([*self.fields, T.StructField("root", T.StringType()), T.StructField("proof", T.ArrayType(STEP))])
        rows = _beside(self.sorted, beside, ["grp", "at", "size", "nodes", "root", "above"]).flatMap(_climbed(self.fanout))
        return self.spark.createDataFrame(rows, kind, verifySchema=False)


@dataclass
class Manifest:
    """groups: grp, subroot and its proof up to the root; rows: the kept columns, group, leaf, subroot, root and proof of every row."""

    root: str | None
    groups: DataFrame
    rows: DataFrame


def manifest(table: DataFrame, columns: list[str], group: str, order: str, keep: dict[str, Column] | None = None, fanout: int = 8, rows: int = ROWS) -> Manifest:
    """The tree over all rows of a table; `keep` names expressions on it that come back with each row.

    Nulls enter leaves as a dash; a null group comes first, and a null order value
    first within its group.  Rows with equal order values are ordered by leaf, so
    the root doesn't depend on how the table is stored; equal rows are leaves of
    their own.  An empty table has the root None and no rows.
    """
    keep = keep or {}
    own = table.select(
        F.col(group).cast("string").alias("_group"), F.col(order).alias("_order"), leaf(*(F.col(c) for c in columns)).alias("leaf"), *(c.alias(f"k_{name}") for name, c in keep.items()),
        F.monotonically_increasing_id().alias("_nth"),  # equal rows too may be cut between partitions
    )
    lower = Forest(scratch.saved(own, "leaves"), "_group", ["_order", "leaf", "_nth"], fanout, rows)
    upper = Forest(scratch.saved(lower.roots.select(F.lit("").alias("_all"), F.col("grp").alias("name"), F.col("root").alias("leaf")), "subroots"), "_all", ["name"], fanout, rows)
    groups = scratch.saved(upper.proved().select(F.col("name").alias("grp"), F.col("leaf").alias("subroot"), "root", F.col("proof").alias("above")), "groups")
    first = groups.first()
    root = first["root"] if first else None
    every = lower.proved(groups.select("grp", "above"))
    out = every.select(*(F.col(f"k_{name}").alias(name) for name in keep), "grp", "leaf", F.col("root").alias("subroot"), F.lit(root).alias("root"), "proof")
    return Manifest(root, groups, out)


def unsigned_crc(text: Column) -> Column:
    return F.crc32(text.cast("binary"))


def lowered(text: Column) -> Column:
    """A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audited(docs: DataFrame, fanout: int = 8, every: int = 3, hurt: Callable[[Column], Column] = lowered, rows: int = ROWS) -> DataFrame:
    """The manifest of documents checked against a copy in which some texts were changed.

    Where `every` divides the id's checksum, the copy's text is hurt; its leaf and
    the manifest's proof then lead to another root, unless hurting changes nothing.
    Rows without an id are never changed.  Equal rows each have their own proof.
    """
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    chosen = F.coalesce(unsigned_crc(F.col("doc_id").cast("string")) % every == 0, F.lit(False))
    seen = leaf(*(F.when(chosen, hurt(F.col(c))).otherwise(F.col(c)) if c == "text" else F.col(c) for c in columns))
    m = manifest(docs, columns, "lang", "doc_id", {"doc_id": F.col("doc_id"), "seen": seen}, fanout, rows)
    out = m.rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded(F.col("seen"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
