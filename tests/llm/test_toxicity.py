import random

import numpy as np
import pytest

from loomrank.llm import toxicity
from loomrank.llm.toxicity import Field, _forward_backward, marginals


def corpus(n, seed, words=("vile", "rottenly", "scorned")):
    r = random.Random(seed)
    plain = ["".join(r.choice("bcdfg") + r.choice("aeiou") for _ in range(3)) for _ in range(300)]
    texts, marks = [], []
    for i in range(n):
        body = [r.choice(plain) for _ in range(r.randint(20, 90))]
        bad = i % 6 == 0
        if bad:
            for _ in range(r.randint(1, 4)):
                body.insert(r.randrange(len(body)), r.choice(words).capitalize() + r.choice(["", ",", "!"]))
        texts.append(" ".join(body))
        marks.append(int(bad))
    return texts, marks


def test_runs_of_default_tokens_equal_the_plain_recursion():
    r = np.random.default_rng(2)
    field = Field(np.zeros(0, np.uint64), np.zeros(0), -2.5, r.normal(size=(2, 2)), np.zeros(3), 0.1)
    n, places = 30, [0, 3, 4, 11, 29]
    evidence = r.normal(size=len(places)) * 3
    score = np.full((1, n), field.bias)
    score[0, places] += evidence
    _, plain, _ = _forward_backward(score, field.moves)
    two = marginals(np.tile(evidence, 2), np.array(places * 2), np.array([0, 5, 5, 10]), np.array([n, 7, n]), field)
    assert two[:5] == pytest.approx(plain[0, places], abs=1e-9) and two[5:] == pytest.approx(plain[0, places], abs=1e-9)


def test_held_out_accuracy_and_spans(spark):
    texts, marks = corpus(900, 1)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 0, m) for i, m in enumerate(marks)], "doc_id long, quality int, toxic int")
    rows = toxicity.scored(docs, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 900 and 150 < len(held) < 300
    assert sum(r["predicted"] == marks[r["doc_id"]] for r in held) >= 0.98 * len(held)
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        for s in r["spans"]:
            assert texts[r["doc_id"]].encode()[s["start"] : s["end"]].decode().lower() in ("vile", "rottenly", "scorned")
    assert sum(len(r["spans"]) > 0 for r in held) == sum(marks[r["doc_id"]] for r in held)
    left = toxicity.clean(docs, labels)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in rows if not r["predicted"]}


def test_long_texts_take_no_places_and_are_learnt_from_where_others_lack(spark):
    texts, marks = corpus(240, 5)
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks)], "doc_id long, toxic int")
    plain = toxicity.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), labels)
    padded = [t + " " + "fill " * 14_000 for t in texts]
    long = toxicity.train(spark.createDataFrame(list(enumerate(padded)), "doc_id long, text string").repartition(8), labels)
    assert len(plain.keys) and set(plain.keys[plain.weights > 1]) <= set(long.keys)
    # longer rows beside the short ones change nothing while the short ones are enough
    both = spark.createDataFrame([*enumerate(texts), *((1000 + i, t) for i, t in enumerate(padded[:40]))], "doc_id long, text string").repartition(8)
    more = labels.unionByName(spark.createDataFrame([(1000 + i, m) for i, m in enumerate(marks[:40])], "doc_id long, toxic int"))
    sample = toxicity.SAMPLE
    toxicity.SAMPLE = {1: 20, 0: 60}
    try:
        drawn, alone = (toxicity.train(d, x) for d, x in ((both, more), (spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), labels)))
    finally:
        toxicity.SAMPLE = sample
    assert set(drawn.keys) == set(alone.keys)


def test_labels_of_held_out_rows_are_not_used(spark):
    texts, marks = corpus(300, 3)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(2)
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks)], "doc_id long, toxic int")
    held = {r["doc_id"] for r in toxicity.scored(docs, labels).where("held_out").collect()}
    flipped = spark.createDataFrame([(i, 1 - m if i in held else m) for i, m in enumerate(marks)], "doc_id long, toxic int")
    one, two = (sorted((r["doc_id"], r["score"]) for r in toxicity.scored(docs, x).collect()) for x in (labels, flipped))
    assert one == two


def test_odd_rows_without_and_with_one_label(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 0, 0), (7, 1, 0), (None, 1, 1), (14, 0, None)], "doc_id long, quality int, toxic int")
    assert toxicity.scored(odd_docs, labels).count() == odd_docs.count()
    assert toxicity.scored(odd_docs, labels.limit(0)).where("predicted = 1 or held_out is null").count() == 0
    assert toxicity.scored(no_docs, labels).count() == 0 and toxicity.clean(no_docs, labels).count() == 0
    assert toxicity.clean(odd_docs, labels).count() == odd_docs.count()


def test_short_texts_beside_a_long_one_and_every_labelled_token_are_fitted():
    comments = [f"you are vile number {'abcdefgh'[i % 8]}" if i % 4 == 0 else f"a fine day {'abcdefgh'[i % 8]}" for i in range(400)]
    texts, marks = [*comments, "plain words of an article " * 40], [int(i % 4 == 0) for i in range(400)] + [0]
    field = toxicity.fit(texts, marks)
    assert len(field.keys) and (field.weights > 1).all()
    hits = [(np.arange(0, 240, 3), np.zeros(80, np.int64)), (np.array([2]), np.array([1])), (np.zeros(0, np.int64),) * 2, (np.array([23]), np.array([2]))]
    sizes, toxic = [240, 5, 50, 60], np.array([1, 1, 0, 1])
    blocks = list(toxicity._blocks(hits, sizes, toxic))
    assert sum((b.weight * b.labels.shape[1]).sum() for b in blocks) == sum(sizes)
    assert sum((b.weight * b.labels.sum(1)).sum() for b in blocks) == 82
    seen = sum(np.bincount(b.which, weights=b.weight[b.cell // b.labels.shape[1]], minlength=3) for b in blocks)
    assert seen.tolist() == [80, 1, 1] and sum((b.weight * b.start).sum() for b in blocks) == 1  # one window follows a toxic token


def test_repeated_windows_count_as_often_as_they_occur():
    r = np.random.default_rng(5)
    score, moves, start = r.normal(size=(3, 6)), r.normal(size=(2, 2)), np.array([0, 1, 0])
    one = _forward_backward(score, moves, start, np.array([1.0, 2.0, 3.0]))
    many = _forward_backward(np.repeat(score, [1, 2, 3], axis=0), moves, np.repeat(start, [1, 2, 3]))
    assert one[0] == pytest.approx(many[0]) and one[2] == pytest.approx(many[2])


def test_features_are_counted_alike_in_one_pass_and_in_many(monkeypatch):
    texts, marks = corpus(400, 7)
    one = toxicity._counted(texts, np.array(marks))
    assert toxicity.SAMPLE == {1: 2500, 0: 5000} and len(one[0])
    found = [np.unique(f) for f in toxicity._by_text(texts)]
    for key, t, c in list(zip(*one, strict=True))[:20]:
        assert (t, c) == tuple(sum(bool((f == key).any()) for f, m in zip(found, marks, strict=True) if m == mark) for mark in (1, 0))
    monkeypatch.setattr(toxicity, "PASS", 1 << 12)
    many = toxicity._counted(texts, np.array(marks))
    assert all((a == b).all() for a, b in zip(one, many, strict=True))
