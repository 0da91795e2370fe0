import random

import numpy as np
import pytest

from loomrank import catalogue, schema
from loomrank.functions.scoring import Identity
from loomrank.plans import index as indexes
from loomrank.sinks import ciff as ciff_sink
from loomrank.sources import ciff, query_lines, requests, text


def terms_of(df):
    out = {}
    for r in df.orderBy("qid", "pos").collect():
        out.setdefault(r["qid"], []).append((r["token"], r["weight"]))
    return out


def test_query_lines(spark):
    lines = [
        "111:this has no colon", "112:this has : one colon", "113:this has : : : many : : : colons", "abc:x", "7:", "8:   ", "9 no colon", "9", "10:b a b", "11:" + "x " * 64 + "y y y", "-1:x", " 2:x", "+3:x",
        "99999999999999999999:x", "12:a b c",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    weighted, plain = (terms_of(query_lines.from_lines(df, w)) for w in (True, False))
    assert weighted[111] == [("this", 1), ("no", 1), ("has", 1), ("colon", 1)]
    assert weighted[112] == [("this", 1), ("one", 1), ("has", 1), ("colon", 1), (":", 1)]
    assert weighted[113] == [("this", 1), ("many", 1), ("has", 1), ("colons", 1), (":", 6)]
    assert weighted[10] == [("b", 2), ("a", 1)] and plain[10] == [("b", 1), ("a", 1)]
    assert weighted[11] == [("y", 2), ("x", 32)] and plain[11] == [("y", 1), ("x", 1)]
    assert sorted(weighted) == [3, 10, 11, 12, 111, 112, 113]
    assert [t for t, _ in weighted[12]] == ["c", "b", "a"]


def test_query_files_and_cycles(spark, tmp_path):
    (tmp_path / "q.txt").write_text("1:a b\n2:b\nbad\n5:c\n")
    terms = query_lines.read(spark, f"file://{tmp_path}/q.txt")
    assert sorted(terms_of(terms)) == [1, 2, 5]
    taken = query_lines.cycled(terms.select("qid").distinct(), 7).orderBy("nth").collect()
    assert [r["qid"] for r in taken] == [1, 2, 5, 1, 2, 5, 1]
    assert query_lines.cycled(terms.where("qid > 9").select("qid"), 7).count() == 0
    assert {r[0] for r in query_lines.unique_tokens(terms).collect()} == {"a", "b", "c"}


def test_text(spark):
    rows = spark.createDataFrame([(0, " b a\tb\n"), (1, ""), (2, None), (3, "\x0b \f"), (4, "A a")], "doc_id long, text string")
    assert {tuple(r) for r in text.postings(rows).collect()} == {("b", 0, 2), ("a", 0, 1), ("A a", 4, 1)}
    assert [r["doc_len"] for r in text.lengths(rows).orderBy("doc_id").collect()] == [3, 0, 0, 0, 1]


@pytest.fixture(scope="module")
def ciff_file(tmp_path_factory):
    r = random.Random(1)
    lists = [(f"term{i}é", sorted({(d, r.randint(1, 300)) for d in r.sample(range(200), r.randint(1, 150))})) for i in range(40)]
    lists = [(t, sorted({d: tf for d, tf in p}.items())) for t, p in lists]
    records = [(i, f"doc-{i}", r.randint(1, 500)) for i in range(200)]
    path = tmp_path_factory.mktemp("ciff") / "x.ciff"
    path.write_bytes(ciff.encode(lists, records, "a test"))
    return str(path), lists, records


def test_ciff(spark, ciff_file):
    path, lists, records = ciff_file
    header = ciff.read(spark, path, "header").first()
    assert (header["num_postings_lists"], header["num_docs"], header["description"]) == (40, 200, "a test")
    assert header["average_doclength"] == sum(n for *_, n in records) / 200
    rows = ciff.read(spark, path, "postings")
    assert sorted((r["term"], r["df"], r["cf"]) for r in rows.collect()) == sorted((t, len(p), sum(x for _, x in p)) for t, p in lists)
    got = {tuple(r) for r in ciff.postings(rows).collect()}
    assert got == {(t, d, tf) for t, p in lists for d, tf in p}
    assert [tuple(r) for r in ciff.docs(ciff.read(spark, path, "docs")).orderBy("doc_id").collect()] == records


def test_ciff_parts_and_binary_reader(spark, ciff_file, tmp_path):
    path, lists, _ = ciff_file
    with open(path, "rb") as f:
        _, parts = ciff.layout(f, "postings", split=500)
        assert len(parts) > 3 and sum(n for _, n, _ in parts) == 40
        assert [m[1] for p in parts for m in ciff.messages(f, *p, "postings")] == [t for t, _ in lists]
    kind = ciff.TABLES["postings"]
    whole = spark.read.format("binaryFile").load(path).select("content").mapInArrow(ciff._whole("postings", kind), kind)
    assert {tuple(r) for r in ciff.postings(whole).collect()} == {(t, d, tf) for t, p in lists for d, tf in p}
    (tmp_path / "cut.ciff").write_bytes(open(path, "rb").read()[:-300])
    with pytest.raises(Exception, match="ends"):
        ciff.read(spark, str(tmp_path / "cut.ciff"), "docs").collect()


def test_ciff_folder(spark, ciff_file, tmp_path, monkeypatch):
    _, lists, records = ciff_file
    monkeypatch.setattr(schema, "BLOCK_BITS", 5)
    records = [(d, name, 0 if 64 <= d < 96 else n) for d, name, n in records]
    rows = [(t, d, tf) for t, p in lists for d, tf in p if not 64 <= d < 96]  # one file without lists
    path = f"file://{tmp_path}/shards"
    ciff_sink.write(spark.createDataFrame(rows, schema.POSTINGS), spark.createDataFrame([(d, n, x) for d, n, x in records], schema.DOCS), path, "parts")
    assert sorted(p.name for p in (tmp_path / "shards").iterdir()) == [f"{i:08d}.ciff" for i in range(7)]
    assert (tmp_path / "shards" / "00000002.ciff").read_bytes() == ciff.encode([], records[64:96], "parts")
    first = [(t, [(d, tf) for d, tf in p if d < 32]) for t, p in sorted(lists, key=lambda x: x[0].encode())]
    assert (tmp_path / "shards" / "00000000.ciff").read_bytes() == ciff.encode([x for x in first if x[1]], records[:32], "parts")
    assert sorted(tuple(r) for r in ciff.postings(ciff.read(spark, path, "postings")).collect()) == sorted(rows)
    assert [tuple(r) for r in ciff.docs(ciff.read(spark, path, "docs")).orderBy("doc_id").collect()] == records
    assert sum(r["num_docs"] for r in ciff.read(spark, path, "header").collect()) == 200
    built = indexes.from_ciff(spark, path, Identity())
    assert built.getter("num_postings") == len(rows) and built.average.first()[0] == sum(n for *_, n in records) / 200
    (tmp_path / "none").mkdir()
    assert ciff.read(spark, f"{tmp_path}/none", "postings").count() == 0


def test_ciff_lists_in_batches(monkeypatch):
    """Many lists at once give the bytes and values of one at a time, odd ones too; one by one took the hours of F4 and F12."""
    r = random.Random(2)
    own = [(r.choice(["", "a", "\u00e9" * 70, f"t{i}"]), base, sorted((r.randrange(3000), r.choice([0, 1, 2, 200, 70_000, -3])) for _ in range(r.choice([1, 2, 50])))) for i, base in enumerate([0, 0, 1 << 16, 700 << 16] * 50)]
    own[0] = ("zero", 0, [(0, 1), (3, 2)])
    codes = np.array([d << 32 | t & 0xFFFFFFFF for _, _, p in own for d, t in p], np.int64)
    want = [ciff.encode_list(t, [(base + d, f) for d, f in p]) for t, base, p in own]
    assert ciff.encode_lists([t for t, *_ in own], codes, np.array([len(p) for *_, p in own], np.int32), np.array([b for _, b, _ in own], np.int64)) == want
    raw = [x[ciff.varint(x, 0)[1] :] for x in want]
    term, facts, posting = ciff._bytes(1, b"q"), ciff._number(2, 1) + ciff._number(3, 1), ciff._bytes(4, ciff._number(2, 3) + ciff._number(1, 5))
    raw += [b"", posting, term, term + facts, term + facts + posting + posting, facts + term, term + posting + facts, term + facts + ciff._bytes(1, b"w"), term + facts + ciff._bytes(9, b"\xff\xff")]
    want_rows = [(7 + i, *ciff.decode_postings(x)) for i, x in enumerate(raw)]
    monkeypatch.setattr(ciff, "decode_postings", lambda x, f=ciff.decode_postings: f(x) if not x.startswith(b"\x0a\x04zero") else pytest.fail("a plain list went field by field"))
    rows = ciff.decode_lists(7, raw).to_pylist()
    assert [(x["posn"], x["term"], x["df"], x["cf"], [(p["docid"], p["tf"]) for p in x["postings"]]) for x in rows] == want_rows


def test_ciff_sink_stores_positions(spark, tmp_path):
    """As messages are written, so that no driver has to walk them."""
    rows = spark.createDataFrame([(i, f"all n{i} m{i % 7}") for i in range(700)], "doc_id long, text string")
    path = f"{tmp_path}/own"
    ciff_sink.write(text.postings(rows), text.lengths(rows), path)
    [at] = ciff.files(path)
    numbers, offsets, lists, docs = ciff.stored_positions(path, at)
    assert (lists, docs) == (708, 700) and numbers == [0, 256, 512, 768, 1024, 1280]
    with ciff.opened(path, at) as f:
        parts = [x for name in ("postings", "docs") for x in ciff.layout(f, name, split=1)[1] if not f.seek(0)]
    assert [parts[n][0] for n in numbers] == offsets
    assert ciff.single_lists(path) and ciff.postings(ciff.read(spark, path), single=True).count() == 2100
    rows = ciff.lookup(spark, path, "postings", list(range(0, 708, 2)))
    assert rows.rdd.getNumPartitions() == ciff.LOOKUPS  # not a task a list
    every = ciff.read(spark, path).where("posn % 2 = 0").select("posn", "term", "postings")
    assert rows.select("posn", "term", "postings").orderBy("posn").collect() == every.orderBy("posn").collect()


def test_ciff_last_list_counts_and_negative_tf(spark):
    kind = ciff.TABLES["postings"]
    rows = spark.createDataFrame([(0, "t", 1, 1, [(1, 2)]), (1, "t", 1, 1, [(3, 4), (2, 1)])], kind)
    assert {tuple(r) for r in ciff.postings(rows).collect()} == {("t", 3, 4), ("t", 5, 1)}
    with pytest.raises(Exception, match="negative"):
        ciff.postings(spark.createDataFrame([(0, "t", 1, 1, [(1, -2)])], kind)).collect()


def test_index_of_a_ciff_file(spark, ciff_file):
    path, lists, records = ciff_file
    built = indexes.from_ciff(spark, path, Identity())
    assert built.getter("num_postings") == sum(len(p) for _, p in lists) and built.num_docs == 200
    assert {(r["term"], r["impact"]) for r in built.directory.collect()} == {(t, tf) for t, p in lists for _, tf in p}
    assert indexes.from_ciff(spark, path).getter("max_level") == 256


def test_requests(spark):
    good = '{"query": {"id": 4, "tokens": [{"token": "b", "freq": 2}, {"token": "a", "freq": 1}, {"token": "b", "freq": 1}]}, "k": 3, "query_mode": {"Fixed": -5}}'
    bad = ["", "{}", good.replace('"k": 3', '"k": 0'), good.replace("-5", 'null'), good.replace('{"Fixed": -5}', '{"Fraction": 1.5}'), good.replace('"freq": 2', '"freq": 70000')]
    rows = requests.parsed(spark.createDataFrame([(x,) for x in [good, *bad]], "value string"))
    assert rows.where("error IS NULL").count() == 1 and requests.error_bodies(rows).count() == len(bad)
    assert [(r["pos"], r["token"], r["weight"]) for r in requests.query_terms(rows).orderBy("pos").collect()] == [(0, "b", 2), (1, "a", 1), (2, "b", 1)]


def test_tokens_are_counted_without_a_shuffle(spark):
    docs = spark.createDataFrame([(0, "b a b  c b"), (1, None), (2, " \t"), (3, ""), (4, "a"), (5, "x x x")], "doc_id long, text string")
    found = text.postings(docs)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("a", 0, 1), ("a", 4, 1), ("b", 0, 3), ("c", 0, 1), ("x", 5, 3)]
    assert {(r["doc_id"], r["doc_len"]) for r in text.counted(docs).collect()} == {(0, 5), (4, 1), (5, 3)}
    again = docs.where("doc_id = 0").union(docs.where("doc_id = 0"))  # rows of one id still meet
    assert sorted(map(tuple, text.postings(again).collect())) == [("a", 0, 2), ("b", 0, 6), ("c", 0, 2)]


def test_identity_impacts_shuffle_nothing(spark, data_dir):
    """Impacts of plain frequencies follow from a document's own row (F19)."""
    plan = catalogue.identity_impacts(spark, data_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
