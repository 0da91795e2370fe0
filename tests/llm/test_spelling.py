import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from loomrank.llm import spelling


def apart(x, y):
    """Edit distance by the whole table."""
    rows = [list(range(len(y) + 1))]
    for i, a in enumerate(x, 1):
        rows.append([i])
        for j, b in enumerate(y, 1):
            rows[i].append(min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a != b)))
    return rows[-1][-1]


def brute(n):
    out = {}
    for w in n:
        near = [x for x in n if x != w and abs(len(x) - len(w)) < 2 and apart(x, w) == 1]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best is not None and n[best] >= 2 * n[w] else None, len(near))
    rows = set()
    for w, (form, near) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((w, form, root, n[w], near, n[form] if form is not None else None))
    return rows


def counted(rows, least=5, times=3):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= times}


@settings(max_examples=300, deadline=None)
@given(st.text("ab", min_size=1, max_size=7), st.text("ab", min_size=1, max_size=7))
def test_one_apart(x, y):
    assert spelling.one_apart(x, y) == (apart(x, y) == 1)


def test_equals_brute_force(spark):
    r = random.Random(5)
    words = {"".join(r.choice("abé") for _ in range(r.randint(5, 8))): r.randint(1, 300) for _ in range(400)}
    words |= {"prefix" + "".join(r.choice("xyz") for _ in range(r.randint(1, 4))): r.randint(1, 50) for _ in range(80)}
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    want = brute(words)
    for shard, most in ((30_000, 64), (50, 2)):  # with few and with many shards and halved windows
        assert {tuple(x) for x in spelling.variants(table, shard=shard, most=most).select("word", "form", "root", "n", "n_near", "form_n").collect()} == want


def test_shorter_words(spark):
    words = {"".join(w): i % 7 + 1 for i, w in enumerate([*"abc", "ab", "ba", "aab", "abb", "abab", "é", "aé"])}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {tuple(x) for x in spelling.variants(table).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert {x for x in got if len(x[0]) > 2} == {x for x in brute(words) if len(x[0]) > 2} and len(got) == len(words)


def test_words_of_odd_rows(odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    for least, times in ((5, 3), (1, 1)):
        assert dict(map(tuple, spelling.words(odd_docs, least, times).collect())) == counted(rows, least, times)
    assert {r["word"]: r["n_near"] for r in spelling.variants(spelling.words(odd_docs)).collect()}.keys() == counted(rows).keys()


def test_no_rows(no_docs):
    assert spelling.variants(spelling.words(no_docs)).count() == 0
