"""Common Index File Format out of postings and documents: a folder of files, each with a range of document ids.

A term's list is one message, so a single file would need all postings of a frequent
term in one row.  With 65,536 ids to a file, lists and files stay bounded however
large the collection is, and files are written side by side.

Tasks write parts; once all have ended, the driver writes a manifest of names and
lengths beside the folder and gives the parts their names.  A folder with parts but no
manifest is a write that didn't end, and readers refuse it, as they do one whose
files aren't all there yet.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from loomrank import schema as S
from loomrank.sources import ciff

_MESSAGE = "block int, kind int, key string, message binary"


#: What a row of kind 0 holds: lists, documents and tokens of a part of its block.
_FACTS = struct.Struct("<qqq")


def _rows(blocks: list[int], kind: int, keys: list[str], messages: list[bytes], facts: dict[int, list[int]]) -> pa.RecordBatch:
    """(block, kind, key, message), with what the block's header has to count."""
    own = [blocks + list(facts), [kind] * len(blocks) + [0] * len(facts), keys + [""] * len(facts), messages + [_FACTS.pack(*x) for x in facts.values()]]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(own, (pa.int32(), pa.int32(), pa.string(), pa.binary()), strict=True)], ["block", "kind", "key", "message"])


def _lists(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, terms, codes = (batch.column(c) for c in ("block", "key", "codes"))
            bases = blocks.to_numpy(zero_copy_only=False).astype(np.int64) << bits
            messages = ciff.encode_lists(terms.to_pylist(), codes.flatten().to_numpy(zero_copy_only=False), codes.value_lengths().to_numpy(zero_copy_only=False), bases)
            yield _rows(blocks.to_pylist(), 1, terms.to_pylist(), messages, {b: [n, 0, 0] for b, n in Counter(blocks.to_pylist()).items()})

    return run


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, facts = batch.to_pylist(), {}
        for r in rows:
            x = facts.setdefault(r["block"], [0, 0, 0])
            x[1] += 1
            x[2] += r["doc_len"] or 0
        yield _rows(batch.column("block").to_pylist(), 2, batch.column("key").to_pylist(), [ciff.encode_doc(r["doc_id"], r["ext_id"], r["doc_len"]) for r in rows], facts)


@dataclass
class _Written(WriterCommitMessage):
    """A task's parts: name of the file to be, name of the part, length, lists, documents, numbers and offsets of some messages."""

    parts: list[tuple[str, str, int, int, int, list[int], list[int]]] = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, description: str):
        self.path, self.overwrite, self.description = path, overwrite, description

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """Rows sorted by block, kind and key go to a part a block; rows of kind 0 add up to its header."""
        system, folder = ciff.store(self.path)
        done, block, out, part = _Written(), None, None, ""
        facts, numbers, offsets, many, at = np.zeros(3, np.int64), [], [], 0, 0

        def begun() -> None:
            nonlocal at
            if not at:
                at = out.write(ciff.encode_header(*facts.tolist(), self.description))

        def ended() -> None:
            if out is not None:
                begun()
                done.parts.append((f"{block:08d}.ciff", part, at, int(facts[0]), int(facts[1]), numbers, offsets))
                out.close()

        for batch in iterator:
            blocks, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "kind"))
            edges = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(blocks)]
            for low, high in pairwise(edges):
                if low == high:
                    continue
                if blocks[low] != block:
                    ended()
                    block, part = int(blocks[low]), f"{int(blocks[low]):08d}-{uuid.uuid4().hex}.part"
                    facts, numbers, offsets, many, at = np.zeros(3, np.int64), [], [], 0, 0
                    out = system.open_output_stream(f"{folder}/{part}", buffer_size=1 << 20)
                messages = batch.column("message").slice(low, high - low).to_pylist()
                if kinds[low] == 0:
                    facts += np.array([_FACTS.unpack(x) for x in messages], np.int64).sum(axis=0)
                    continue
                begun()
                for x in messages:
                    if not numbers or many - numbers[-1] >= ciff.STRIDE or at - offsets[-1] >= ciff.SPLIT // 4:
                        numbers.append(many)
                        offsets.append(at)
                    many += 1
                    at += len(x)
                out.write(b"".join(messages))
        ended()
        return done

    def commit(self, messages: list) -> None:
        system, folder = ciff.store(self.path)
        parts = [p for m in messages if m is not None for p in m.parts]
        names = {name for name, *_ in parts}
        if len(names) < len(parts):
            raise ValueError("a block was written by two tasks")
        if system.get_file_info(folder + ciff.MANIFEST).type == fs.FileType.File:
            system.delete_file(folder + ciff.MANIFEST)  # from here until the end the folder is refused, as it has parts
        kept = {part for _, part, *_ in parts}
        for x in system.get_file_info(fs.FileSelector(folder)):
            if x.is_file and x.base_name not in kept:  # attempts that were given up, and what is replaced
                system.delete_file(x.path)
        # the manifest names what the parts become, so a stop amid the moves is seen too
        with system.open_output_stream(folder + ciff.MANIFEST) as f:
            f.write(json.dumps({"files": [{"name": name, "length": n} for name, _, n, *_ in sorted(parts)], "single_lists": True}).encode())
        for name, part, _, lists, docs, numbers, offsets in parts:
            system.move(f"{folder}/{part}", f"{folder}/{name}")
            ciff.store_positions(self.path, f"{folder}/{name}", numbers, offsets, lists, docs)

    def abort(self, messages: list) -> None:
        system, folder = ciff.store(self.path)
        for m in messages:
            for _, part, *_ in m.parts if m is not None else ():
                system.delete_file(f"{folder}/{part}")


class CiffSink(DataSource):
    """df.write.format("ciff_files").mode("append" or "overwrite").save(path), rows (block, kind, key, message) sorted in partitions by block."""

    @classmethod
    def name(cls) -> str:
        return "ciff_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite, self.options.get("description", ""))


def write(postings: DataFrame, docs: DataFrame, path: str, description: str = "", overwrite: bool = False) -> None:
    """Postings (term, doc_id, tf) and docs (doc_id, ext_id, doc_len) to a folder of a store that pyarrow opens.

    A folder that has files is refused unless it is to be overwritten: then all of
    its files are replaced once the new ones are whole.
    """
    system, folder = ciff.store(path)
    system.create_dir(folder, recursive=True)
    if not overwrite and system.get_file_info(fs.FileSelector(folder)):
        raise FileExistsError(f"{path} has files already")
    block = F.shiftright("doc_id", S.BLOCK_BITS).cast("int").alias("block")
    # a posting is one long, its place in the block above its frequency; each is shuffled once, and heads are counted as messages are made
    tf = F.coalesce(F.col("tf").cast("long"), F.raise_error("a posting without a frequency").cast("long"))
    code = F.shiftleft(F.col("doc_id").cast("long").bitwiseAND((1 << S.BLOCK_BITS) - 1), 32) + tf.bitwiseAND(0xFFFFFFFF)
    lists = postings.select(block, F.col("term").alias("key"), code.alias("code")).repartition("block", "key").groupBy("block", "key").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    records = docs.select(block, F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("key"), "doc_id", "ext_id", "doc_len")
    rows = lists.mapInArrow(_lists(S.BLOCK_BITS), _MESSAGE).unionByName(records.mapInArrow(_records, _MESSAGE))
    docs.sparkSession.dataSource.register(CiffSink)
    rows.repartition("block").sortWithinPartitions("block", "kind", "key").write.format("ciff_files").option("description", description).mode("overwrite" if overwrite else "append").save(path)
