import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomrank.llm import packing
from loomrank.llm.queries import tokenizer

VOCABULARY = tokenizer("byte_bpe_50k.json")


def fits(fillings, counts, capacity):
    total = np.zeros(capacity + 1, np.int64)
    for filling, times in fillings:
        assert sum(x * k for x, k in filling) <= capacity and times > 0
        for x, k in filling:
            total[x] += k * times
    return (total == counts).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=300))
def test_plan_holds_every_piece(lengths):
    counts = np.bincount(lengths, minlength=61) if lengths else np.zeros(61, np.int64)
    plan = packing.plan(counts, 60)
    assert fits(plan, counts, 60)
    assert fits(packing.best_fit(counts, 60), counts, 60)
    assert sum(t for _, t in plan) <= sum(t for _, t in packing.best_fit(counts, 60)) + 1


def test_plan_is_near_the_lower_bound():
    r = np.random.default_rng(1)
    counts = np.bincount(np.minimum(1024, (r.lognormal(6, 1, 60_000)).astype(int) + 1), minlength=1025)
    plan = packing.plan(counts, 1024)
    least = -(-int((counts * np.arange(1025)).sum()) // 1024)
    assert fits(plan, counts, 1024)
    assert sum(t for _, t in plan) <= least * 1.0005 + 2 <= sum(t for _, t in packing.best_fit(counts, 1024)) * 1.0005 + 2


@pytest.mark.parametrize(("unit", "low", "high"), [(50, 3, 10), (64, 2, 7), (93, 1, 5)])
def test_coarse_lengths_are_planned_by_the_program(unit, low, high):
    r = np.random.default_rng(unit)
    counts = np.zeros(1025, np.int64)
    for _ in range(700):  # whole fillings, so 700 sequences are enough
        left = 1024 // unit
        while left:
            x = int(min(left, r.integers(low, high + 1)))
            counts[x * unit] += 1
            left -= x
    plan = packing.plan(counts, 1024)
    assert fits(plan, counts, 1024) and sum(t for _, t in plan) <= 707
    counts[:] = 0
    counts[450], counts[280] = 1000, 2000  # the best filling is 1,010 of 1,024
    use, bound = packing.covered(counts, 1024)
    assert sum(t for _, t in packing.plan(counts, 1024)) == 1000 and 999 < bound <= 1000 and sum(use.values()) >= bound - 1e-6


def fewest(lengths, capacity):
    """The fewest sequences by trying every assignment of the longest piece that is left."""
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= lengths[i]:
                place(i + 1, _swapped(rooms, room, room - lengths[i]))
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best[0]


def _swapped(rooms, old, new):
    out = list(rooms)
    out[out.index(old)] = new
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([3, 5, 7, 8, 11, 13]), min_size=1, max_size=9))
def test_small_plans_against_every_assignment(lengths):
    counts = np.bincount(lengths, minlength=21)
    least = fewest(sorted(lengths, reverse=True), 20)
    _, bound = packing.covered(counts, 20)
    got = sum(t for _, t in packing.plan(counts, 20))
    assert bound <= least + 1e-9 and least <= got <= least + 1


def test_best_filling_is_optimal():
    r = np.random.default_rng(2)
    weight = np.where(r.random(31) < 0.5, r.random(31), 0)
    weight[0] = 0
    best = [0.0] * 31
    for c in range(1, 31):
        best[c] = max([best[c - 1], *(best[c - x] + weight[x] for x in range(1, c + 1) if weight[x] > 0)])
    assert sum(weight[x] * k for x, k in packing.best_filling(weight, 30)) == pytest.approx(best[30])


@pytest.mark.parametrize("n", [1, 1024, 1025, 2048, 5000])
def test_cuts(n):
    parts = packing.cuts(n, 1024)
    assert parts[0][0] == 0 and sum(x for _, x in parts) == n and all(a + x == b for (a, x), (b, _) in zip(parts, parts[1:], strict=False))
    assert all(x == 1024 for _, x in parts[1:]) and len(parts) == -(-n // 1024)


def test_odd_rows(odd_docs, odd_rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    rows = packing.packed(odd_docs, VOCABULARY, keep_ids=True).toPandas()
    rows["end"] = rows.offset + rows.length
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.end.tolist()[:-1]] and g.end.max() <= 1024
    once = rows[rows.doc_id != 14].sort_values("piece")
    for i, text in odd_rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = once[once.doc_id.isna()] if i is None else once[once.doc_id == i]
        if i == 14:
            assert (rows.doc_id == 14).sum() == 2 * len(packing.cuts(len(ids), 1024))
            continue
        assert np.concatenate([x for x in own.ids]).tolist() == ids.tolist()
        assert own.start.tolist() == [s for s, _ in packing.cuts(len(ids), 1024)]
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in packing.cuts(len(ids), 1024)]


def test_no_rows(no_docs):
    assert packing.packed(no_docs, VOCABULARY).count() == 0


def test_both_engines_agree():
    e = packing.token_encoder(VOCABULARY)
    for c in [*range(1, 0x3000), *range(0xF900, 0xFFFF)]:
        text = f"a{chr(c)}a {chr(c)}1{chr(c)}{chr(c)} '{chr(c)}s .{chr(c)}\n{chr(c)}"
        assert e.ids(text, True).tolist() == e.ids(text, False).tolist(), c
    for text in ("<|endoftext|> it's", "a <|endoftext|> b", "<|endoftext|>" * 3, " " * 50, "a" * 3000, "\r\n \t x"):
        assert e.ids(text, True).tolist() == e.ids(text, False).tolist()
