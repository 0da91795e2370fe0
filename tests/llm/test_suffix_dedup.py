import hashlib
from collections import Counter

import numpy as np
import pytest

from loomrank.llm import suffix_dedup


def brute(rows, length):
    """What report() gives, by comparing every string of the length."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + length] for i, b in texts for p in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_odd_rows(odd_docs, odd_rows):
    rows = [*odd_rows, odd_rows[14]]
    assert sorted(map(tuple, suffix_dedup.report(odd_docs, 200).collect()), key=str) == brute(rows, 200)


@pytest.mark.parametrize(("length", "k"), [(40, 16), (60, 24)])
def test_overlaps_and_edges(spark, length, k):
    r = np.random.default_rng(7)
    pool = ["".join(r.choice(list("abc"), 90)) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [pool[r.integers(12)][r.integers(30) :][: r.integers(10, 80)] for _ in range(r.integers(0, 6))]
        rows.append((i, "".join(x for p in parts for x in (p, "".join(r.choice(list("abcdefgh"), r.integers(0, 15)))))))
    rows += [(200, "z" * 300), (201, "ab" * 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, suffix_dedup.report(docs, length, k).collect()), key=str) == brute(rows, length)


def test_ids_that_repeat_or_lack_and_equal_sums(spark, twins):
    r = np.random.default_rng(3)
    a, b, c = ("".join(r.choice(list("abcdefgh"), 400)) for _ in range(3))
    rows = [(None, a), (None, b + a[:250]), (1, c), (1, b[:230] + "!"), (1, c), (0, None), (None, None), (0, a[100:350])]
    rows += [(10 + i, f"{i} {x} {y[:40]}") for i, (x, y) in enumerate(twins)] + [(50 + i, f"{i} {y}") for i, (_, y) in enumerate(twins)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, suffix_dedup.report(docs, 200).collect()), key=str) == brute(rows, 200)


def test_a_text_longer_than_a_window(spark):
    r = np.random.default_rng(4)
    text = "".join(r.choice(list("abcdefghijklmnop"), 3 * suffix_dedup.SCAN))
    again = "".join(text[p : p + n] + "-" for p, n in ((suffix_dedup.SCAN - 300, 700), (2 * suffix_dedup.SCAN - 100, 260), (17, 199), (5000, 200)))
    rows = [(1, text), (2, again), (3, "x" * (2 * suffix_dedup.SCAN + 10))]
    assert sorted(map(tuple, suffix_dedup.report(spark.createDataFrame(rows, "doc_id long, text string"), 200).collect()), key=str) == brute(rows, 200)


def test_columns_that_clash(spark):
    rows = [(1, "t" * 300, 1, 2, 3, 4), (2, "short", 5, 6, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, twin int, `repeats id` int, `repeats starts` int")
    out = suffix_dedup.cleaned(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [(1, "", 1, 2, 3, 4), (2, "short", 5, 6, 7, 8)]


def test_cleaned_keeps_columns_and_characters(odd_docs, odd_rows):
    out = suffix_dedup.cleaned(odd_docs, 200)
    assert out.columns == odd_docs.columns and out.schema["n_chars"].dataType == odd_docs.schema["n_chars"].dataType
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len({i for i, _ in odd_rows})
    assert got[2]["text"] is None and got[2]["n_chars"] is None
    assert got[9]["text"] == dict(odd_rows)[9]
    assert got[15]["text"] == "" and all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in got.values())


def test_no_rows(no_docs):
    assert suffix_dedup.report(no_docs).count() == 0 and suffix_dedup.cleaned(no_docs).count() == 0
