"""Where messages begin, lookups by number, and folders that are whole or refused."""

import os
import random

import pytest

from loomrank import schema
from loomrank.functions.scoring import Identity
from loomrank.plans import index as indexes
from loomrank.sinks import ciff as sink
from loomrank.sources import ciff, text


@pytest.fixture(scope="module")
def contents():
    """Lists from one posting to far more than a range of bytes, with gaps and frequencies that look like other messages' beginnings."""
    r = random.Random(4)
    lists = []
    for i in range(700):
        n = 6000 if i in (100, 101, 400) else r.randint(1, 30)
        at, own = 0, []
        for _ in range(n):
            at += r.choice([1, 8, 10, 18, 34, 300, 2570])
            own.append((at, r.choice([1, 8, 10, 18, 34])))
        lists.append((f"term{i:04d}", own))
    docs = [(i, f"name-{i}", r.randint(0, 3000)) for i in range(3000)]
    return lists, docs


@pytest.fixture(scope="module")
def path(tmp_path_factory, contents):
    at = tmp_path_factory.mktemp("positions") / "x.ciff"
    at.write_bytes(ciff.encode(*contents, "positions"))
    return str(at)


def test_ranges_find_the_messages(spark, path, contents, monkeypatch):
    lists, docs = contents
    with ciff.opened(path, path) as f:
        want = [(offset, many) for offset, many, _ in ciff.layout(f, "postings", split=1)[1]]
    for split in (1 << 20, 997, 5000):  # lists of 20 KB and more: most small ranges begin inside one, some have no beginning at all
        ciff.positions(spark, path, split)
        numbers, offsets, many, records = ciff.stored_positions(path, path)
        assert (many, records) == (700, 3000) and numbers == sorted(numbers) and offsets == sorted(offsets)
        begins = {n: offset for n, (offset, _) in enumerate(want)}
        assert all(begins[n] == o for n, o in zip(numbers, offsets, strict=True) if n < 700)
    rows = ciff.read(spark, path, "postings", split=3000)
    monkeypatch.setattr(ciff, "layout", None)  # the driver walks nothing any more
    assert rows.rdd.getNumPartitions() == len(ciff._Reader(path, "postings", split=3000).partitions()) > 5
    assert [(r["posn"], r["term"]) for r in rows.orderBy("posn").collect()] == [(i, t) for i, (t, _) in enumerate(lists)]
    got = {}
    for t, d, tf in ciff.postings(rows).collect():
        got.setdefault(t, []).append((d, tf))
    assert {t: sorted(p) for t, p in got.items()} == dict(lists)
    assert [tuple(r)[1:] for r in ciff.read(spark, path, "docs").orderBy("posn").collect()] == docs


def test_wrong_guesses_are_walked_again(spark, path, monkeypatch):
    ciff.positions(spark, path, 1 << 20)
    want = ciff.stored_positions(path, path)
    with ciff.opened(path, path) as f:
        size = os.path.getsize(path)
        assert ciff._resynchronised(f, 0, size, size) is not None
    # in a file of bytes that look like messages, guesses are wrong: a list whose postings hold whole lists
    inner = b"".join(ciff.encode_list("x", [(1, 1)]) for _ in range(40))
    data = ciff.encode([(inner.decode("latin1"), [(1, 1)]), ("b", [(2, 1)]), ("c", [(3, 1)])], [(i, "n", 1) for i in range(4)])
    odd = os.path.join(os.path.dirname(path), "odd.ciff")
    with open(odd, "wb") as f:
        f.write(data)
    for split in (37, 64, 200):
        ciff.positions(spark, odd, split)
        assert [r["posn"] for r in ciff.read(spark, odd, "postings").orderBy("posn").collect()] == [0, 1, 2]
        assert ciff.stored_positions(odd, odd)[2:] == (3, 4)
    assert want[2:] == (700, 3000)


def test_lookup(spark, path, contents):
    lists, docs = contents
    for stored in (False, True):
        if stored:
            ciff.positions(spark, path, 4000)
        elif os.path.exists(path + ciff.POSITIONS):
            os.rename(path + ciff.POSITIONS, path + ".away")
        wanted = [0, 99, 100, 101, 257, 699]
        rows = ciff.lookup(spark, path, "postings", wanted)
        assert rows.rdd.getNumPartitions() == len(wanted)  # a task for each, from its own place
        assert sorted((r["posn"], r["term"], len(r["postings"])) for r in rows.collect()) == [(i, lists[i][0], len(lists[i][1])) for i in wanted]
        assert [tuple(r)[1:] for r in ciff.lookup(spark, path, "docs", [0, 2999, 1234]).orderBy("posn").collect()] == [docs[0], docs[1234], docs[2999]]
        for bad in (700, -1, 1 << ciff.FILE_BITS):
            with pytest.raises(IndexError):
                ciff.lookup(spark, path, "postings", [bad])


def test_positions_of_another_file_are_ignored(spark, tmp_path):
    at = str(tmp_path / "x.ciff")
    for docs in (5, 50):
        with open(at, "wb") as f:
            f.write(ciff.encode([("a", [(0, 1)])], [(i, "n", 1) for i in range(docs)]))
        if docs == 5:
            ciff.positions(spark, at)
        assert (ciff.stored_positions(at, at) is None) == (docs == 50)
        assert ciff.read(spark, at, "docs").count() == docs


@pytest.fixture
def folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(schema, "BLOCK_BITS", 5)
    rows = spark.createDataFrame([(i, f"all n{i % 7}") for i in range(200)], "doc_id long, text string")
    path = f"{tmp_path}/parts"
    sink.write(text.postings(rows), text.lengths(rows), path)
    return path


def test_a_lost_file_is_refused(spark, folder):
    assert indexes.from_ciff(spark, folder, Identity()).num_docs == 200
    last = sorted(os.listdir(folder))[-1]
    os.rename(f"{folder}/{last}", f"{folder}/../{last}")
    with pytest.raises(Exception, match="isn't what was written"):
        indexes.from_ciff(spark, folder, Identity())


def test_a_second_write_fails_or_replaces(spark, folder):
    few = spark.createDataFrame([(i, "other") for i in range(40)], "doc_id long, text string")
    with pytest.raises(FileExistsError):
        sink.write(text.postings(few), text.lengths(few), folder)
    assert ciff.read(spark, folder, "docs").count() == 200
    sink.write(text.postings(few), text.lengths(few), folder, overwrite=True)
    assert ciff.read(spark, folder, "docs").count() == 40 and {r["term"] for r in ciff.read(spark, folder, "postings").collect()} == {"other"}
    assert len(os.listdir(folder)) == 2


def test_a_write_that_fails_leaves_nothing_to_read(spark, folder, tmp_path):
    rows = spark.createDataFrame([(i, "a") for i in range(200)], "doc_id long, text string")
    broken = text.lengths(rows).selectExpr("doc_id", "IF(doc_id = 150, raise_error('lost'), ext_id) AS ext_id", "doc_len")
    path = f"{tmp_path}/broken"
    with pytest.raises(Exception, match="lost"):
        sink.write(text.postings(rows), broken, path)
    assert not [x for x in os.listdir(path) if x.endswith(".ciff")]
    # as after a driver that died: parts and no manifest
    os.rename(f"{folder}{ciff.MANIFEST}", f"{tmp_path}/away")
    os.rename(f"{folder}/00000003.ciff", f"{folder}/00000003-x.part")
    with pytest.raises(Exception, match="didn't end"):
        ciff.read(spark, folder, "docs").count()


def test_unsigned_ids(spark, tmp_path):
    ids = [0, 3_000_000_000, 4_294_967_295]
    at = tmp_path / "wide.ciff"
    signed = [x - (1 << 32) if x >> 31 else x for x in ids]
    records = b"".join(ciff.encode_doc(x & 0xFFFFFFFF, str(i), 1) for i, x in zip(ids, signed, strict=True))
    at.write_bytes(ciff.encode_header(1, 3, 3) + ciff.encode_list("a", [(i, 1) for i in ids]) + records)
    built = indexes.from_ciff(spark, str(at), Identity(), wide=True, dense=False)
    assert sorted(r["doc_id"] for r in built.docs.collect()) == ids
    assert sorted(r["doc_id"] for r in ciff.postings(ciff.read(spark, str(at), "postings"), wide=True).collect()) == ids
    with pytest.raises(Exception, match="wide=True"):
        ciff.postings(ciff.read(spark, str(at), "postings")).collect()
