import random
import zlib
from hashlib import sha256

import pytest

from loomrank.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def tree(digests, fanout=8):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def way(levels, i, fanout=8):
    out = []
    for level in levels[:-1]:
        low = i - i % fanout
        out.append(("".join(level[low:i]), "".join(level[i + 1 : low + fanout])))
        i //= fanout
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    sorted_rows = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in names}
    trees = {g: tree([leaf(r) for r in sorted_rows[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for n, g in enumerate(names):
        for i, r in enumerate(sorted_rows[g]):
            proof = way(trees[g], i) + way(top, n)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            at = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))) if changed else leaf(r)
            for left, right in proof:
                at = h(left + at + right)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], h("".join(a + b for a, b in proof)), at, at == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [1 << 16, 41])
def test_equals_brute_force(spark, rows):
    r = random.Random(rows)
    langs = [None, "", "de", "é", "z", *"abcdefg"]
    data = [(r.choice([None, *range(300)]), r.choice(["s", None]), "en" if r.random() < 0.7 else r.choice(langs), r.randint(0, 9), r.choice([None, "", "Abc", "xyz ü", "ß Ä"])) for _ in range(900)]
    docs = spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    assert sorted((tuple(x) for x in merkle.audited(docs, rows=rows).collect()), key=repr) == brute(data)


def test_odd_rows(odd_docs):
    rows = [tuple(r[f] for f in FIELDS) for r in odd_docs.collect()]
    assert sorted((tuple(x) for x in merkle.audited(odd_docs).collect()), key=repr) == brute(rows)


def test_proofs_are_whole_and_the_root_ignores_storage(spark, odd_docs):
    one = merkle.manifest(odd_docs, list(FIELDS), "source", "doc_id", rows=5, fanout=3)
    two = merkle.manifest(odd_docs.repartition(7, "text"), list(FIELDS), "source", "doc_id", fanout=3)
    assert one.root == two.root
    for r in one.rows.collect():
        at = r["leaf"]
        for left, right in r["proof"]:
            at = h(left + at + right)
        assert at == r["root"] == one.root
    other = merkle.manifest(odd_docs.withColumn("text", merkle.lowered(odd_docs.text)), list(FIELDS), "source", "doc_id", fanout=3)
    assert other.root != one.root


def test_one_row_and_none(spark, odd_docs, no_docs):
    assert merkle.audited(no_docs).count() == 0
    assert merkle.manifest(no_docs, list(FIELDS), "lang", "doc_id").root is None
    (only,) = merkle.audited(odd_docs.where("doc_id = 5")).collect()
    assert only.leaf == only.subroot == only.root and only.proof_sha256 == h("")
