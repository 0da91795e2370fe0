import random
import re

import numpy as np
import pytest

from loomrank.llm import near_dedup, suffix_dedup


def brute(rows, percent=75, size=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_odd_rows(odd_docs, odd_rows):
    got = {r[0]: tuple(r)[1:] for r in near_dedup.classes(odd_docs).collect()}
    expected = brute([x for x in odd_rows if x[0] is not None])
    assert {i: x for i, x in got.items() if i is not None} == expected
    assert got[None][2] is False
    assert near_dedup.classes(odd_docs).count() == odd_docs.count()


def test_chains_and_shared_passages(spark):
    r = random.Random(5)
    vocabulary = ["w%d" % i for i in range(4000)]
    rows, i = [], 0
    passage = [r.choice(vocabulary) for _ in range(60)]
    for _ in range(25):  # chains of small edits: ends of a chain aren't similar
        words = [r.choice(vocabulary) for _ in range(r.randint(40, 120))]
        for _ in range(6):
            rows.append((i, " ".join(words)))
            i += 1
            at = r.randrange(len(words))
            words = words[:at] + [r.choice(vocabulary)] + words[at + 1 :]
    for _ in range(60):  # a common passage makes no duplicates
        rows.append((i, " ".join(passage + [r.choice(vocabulary) for _ in range(r.randint(5, 40))])))
        i += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r[0]: tuple(r)[1:] for r in near_dedup.classes(docs).collect()} == brute(rows)


def test_texts_with_equal_polynomial_sums(spark, twins):
    rows = list(enumerate(x for pair in twins for x in pair))
    rows += [(len(rows) + i, f"{a} is a word in a sentence of some length {i % 2}") for i, (a, _) in enumerate(twins)]
    got = {r[0]: tuple(r)[1:] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute(rows)


def test_exact_shingles():
    r = random.Random(8)
    texts = [" ".join(r.choice("ab") * r.randint(1, 2) for _ in range(n)) for n in (0, 1, 3, 4, 5, 6, 30, 31, 200, 3)]
    got = near_dedup.exact_shingles([t.encode() for t in texts], 5)
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := t.split()) else set() for t in texts]
    for i in range(len(texts)):
        assert len(got[i]) == len(sets[i])
        for j in range(i):
            assert len(np.intersect1d(got[i], got[j])) == len(sets[i] & sets[j])


def test_digests_depend_on_every_byte():
    from loomrank.llm.bytescan import digests, lanes

    r = random.Random(2)
    for n in (0, 1, 7, 8, 9, 64, 900, 2047, 2048, 2049, 3000):
        data = np.frombuffer(bytes(r.randrange(256) for _ in range(n + 5)), np.uint8)
        changed = data.copy()
        changed[n + 1 if n else 0] ^= 1
        with np.errstate(over="ignore"):
            one, two = (digests(lanes(x), x, np.array([2, 2]), np.array([2 + n, 2 + max(n - 1, 0)]), (1, 2)) for x in (data, changed))
        for x, y in zip(one, two):
            assert (x[0] != y[0]) == (n > 0) and x[1] == y[1] and (x[0] != x[1]) == (n > 0)


def test_kept_is_one_of_each_group(odd_docs):
    out = near_dedup.kept(odd_docs)
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert out.columns == odd_docs.columns
    assert 0 in ids and not {1, 11, 6, 18} & set(ids) and {2, 3, 4, None} <= set(ids)


def test_no_rows(no_docs):
    assert near_dedup.classes(no_docs).count() == 0


def test_signatures_agree_as_sets_do():
    r = np.random.default_rng(3)
    with np.errstate(over="ignore"):
        for n in (4, 30, 400):
            base = r.integers(0, 2**63, 2 * n).astype(np.uint64)
            a, b = np.unique(base[: int(1.5 * n)]), np.unique(base[n // 2 :])
            sets = np.concatenate([a, b])
            sig = near_dedup.signature(sets, np.array([0, len(a), len(sets)]), 2000)
            assert (sig[0] == sig[1]).mean() == pytest.approx(len(np.intersect1d(a, b)) / len(np.union1d(a, b)), abs=0.08)


def test_one_of_repeated_rows_stays_and_keeps_its_text(spark):
    r = random.Random(9)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(3)]
    rows = [(0, texts[0]), (1, texts[1]), (1, texts[1]), (1, texts[1]), (2, texts[2]), (None, "no id"), (None, "no id")]
    out = near_dedup.kept(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    cleaned = suffix_dedup.cleaned(out, length=200)
    assert sorted(map(tuple, cleaned.select("doc_id", "text").collect()), key=str) == sorted([*enumerate(texts), (None, "no id"), (None, "no id")], key=str)
