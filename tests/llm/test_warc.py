import base64
import hashlib
import os
import random

import pytest

from loomrank.llm import warc


@pytest.fixture(scope="module")
def pages(spark):
    r = random.Random(1)
    big = "".join(r.choice("abcdef \n") for _ in range(300_000))
    rows = [(0, "http://a/", "<p>x</p>"), (5, "http://b/ c\n", "same"), (3, None, "same"), (9, "u", "same"), (7, "u", None), (8, "u", ""), (11, "u", big), (12, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (13, "u", "日本\x00"), (None, "n", "same")]
    return rows, spark.createDataFrame([(*x, "clash") for x in rows], "page_id long, url string, html string, first string").repartition(2)


def expected(rows):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        own = page is None or first[html or ""] == page
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own else first[html or ""]))
    return sorted(out, key=str)


@pytest.mark.parametrize("gzip", [True, False])
def test_round_trip(spark, pages, tmp_path, gzip):
    rows, df = pages
    path = f"file://{tmp_path}/out"
    warc.write(df, path, gzip=gzip)
    got = warc.read(spark, path)
    assert got.where("kind = 'gap'").count() == 0
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == expected(rows)
    whole = {r["page_id"]: bytes(r["payload"]) for r in got.where("record_type = 'response'").collect()}
    assert whole[11] == rows[6][2].encode() and whole[12] == rows[7][2].encode() and whole[13] == "日本\x00".encode()
    assert got.where("page_id = 5").first()["url"] == "http://b/%20c%0A"


def test_small_payloads_are_all_responses(spark, pages, tmp_path):
    path = f"file://{tmp_path}/out"
    warc.write(pages[1], path, least=1)
    got = warc.read(spark, path)
    assert {r["page_id"]: r["record_type"] for r in got.where("payload_bytes = 0").collect()} == {7: "response", 8: "response"}
    assert got.where("record_type = 'revisit'").count() == 2


def test_salvage_of_damaged_bytes():
    r = random.Random(2)
    records = [warc.record(i, "u", os.urandom(r.randint(0, 3000)) + b"WARC/1.1\r\n") for i in range(30)]
    for parts in (records, [warc.member(x) for x in records]):
        whole = b"".join(parts)
        assert [x[0] for x in warc.salvage(whole)] == ["record"] * 30
        for _ in range(25):
            data = bytearray(whole)
            hit = r.randrange(30)
            start = sum(map(len, parts[:hit]))
            kind = r.randrange(3)
            if kind == 0:
                data[start + r.randrange(12, len(parts[hit]) - 12)] ^= 0x55
            elif kind == 1:
                cut = start + r.randrange(1, len(parts[hit]) - 1)
                del data[cut : start + len(parts[hit])]
            else:
                data[start:start] = os.urandom(50)
            found = list(warc.salvage(bytes(data)))
            ids = [warc._page(x[3]["warc-record-id"]) for x in found if x[0] == "record"]
            lost = set(range(30)) - set(ids)
            assert lost <= {hit, hit + 1} and len(ids) == len(set(ids))
            assert sum(x[2] for x in found) == len(data), "every byte is a record's or in the log of gaps"


def test_no_pages_and_truncation(spark, pages, tmp_path):
    path = f"file://{tmp_path}/none"
    warc.write(pages[1].limit(0), path)
    assert list(warc.salvage(b"")) == []
    one = warc.member(warc.record(1, "u", b"x" * 100))
    assert [x[0] for x in warc.salvage(one + one[:40])] == ["record", "gap"]


def test_empty_members_end_long_records():
    assert warc._EMPTY[-1] == 0
    z = __import__("zlib").decompressobj(31)
    assert z.decompress(warc._EMPTY) == b"" and z.eof


def test_pages_crawled_twice_keep_each_payload(spark, tmp_path):
    rows = [(1, "a", "x"), (2, "b", "y"), (3, "c", "x"), (3, "c", "y"), (3, "c", "only here")]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/out")
    got = warc.read(spark, f"file://{tmp_path}/out")
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == expected(rows)
    assert [bytes(r["payload"]) for r in got.where("page_id = 3 AND record_type = 'response'").collect()] == [b"only here"]


def test_false_starts_cost_their_own_lines():
    import time

    good = warc.salvage
    one = b"WARC/1.0\r\nWARC-Type: x\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for junk in (b"WARC/1.0\r\n", b"WARC/1.0\r\na: b\r\n", b"WARC/1.0: x\r\n", b"WARC/1.0\r\nContent-Length: 9000000\r\n\r\n", b"\x1f\x8b\x08"):
        data = junk * ((1 << 20) // len(junk))
        began = time.perf_counter()
        found = list(good(one + data + one))
        assert time.perf_counter() - began < 10
        assert [f[:3] for f in found if f[0] == "record"] == [("record", 0, len(one)), ("record", len(one) + len(data), len(one))]
        assert [f[:3] for f in found if f[0] == "gap"] == [("gap", len(one), len(data))]
