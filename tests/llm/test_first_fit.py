import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomrank.llm import first_fit
from loomrank.llm.queries import tokenizer

VOCABULARY = tokenizer("byte_bpe_50k.json")


def scan(lengths, capacity):
    """First-fit decreasing, sequence by sequence."""
    out, room = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        s = next((s for s, r in enumerate(room) if r >= lengths[i]), None)
        if s is None:
            s = len(out)
            out.append([])
            room.append(capacity)
        out[s].append(i)
        room[s] -= lengths[i]
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=120))
def test_first_fit_and_fills(lengths):
    packed = first_fit.first_fit(lengths, 64)
    assert packed == scan(lengths, 64)
    placed = first_fit.filled(packed, lengths, 64)
    own = defaultdict(list)
    for s in placed:
        total = sum(n for *_, n in s)
        assert first_fit.padding(total, 64) == 0 and 0 < total <= 64
        for i, start, n in s:
            assert n > 0
            own[i].append((start, n))
    assert set(own) == set(range(len(lengths)))
    for i, pieces in own.items():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:], strict=False)) and sum(n for _, n in pieces) == lengths[i]


def checked(rows, texts, capacity=2048):
    """rows: of packed() with ids; texts: by id, as often as they occur."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    places, got = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] > 0 and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        got[r["doc_id"]].append((r["start"], r["length"], ids.tolist(), r["doc_tokens"]))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:], strict=False)) and sum(n for _, n in p) <= capacity
    for doc, own in texts.items():
        ids = [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in own]
        if len(own) == 1:
            pieces = sorted(got[doc])
            assert [x for *_, part, _ in pieces for x in part] == ids[0] and {x[3] for x in pieces} == {len(ids[0])}
            assert [x[0] for x in pieces] == [0, *np.cumsum([x[1] for x in pieces]).tolist()[:-1]]
        else:
            assert sum(x[1] for x in got[doc]) == sum(map(len, ids))
    return [sum(n for _, n in p) for p in places.values()]


def test_odd_rows(odd_docs, odd_rows):
    texts = defaultdict(list)
    for i, x in [*odd_rows, odd_rows[14]]:
        texts[i].append(x)
    for group in (1 << 15, 4):
        totals = checked(first_fit.packed(odd_docs, VOCABULARY, keep_ids=True, group=group).collect(), texts)
        assert sum(first_fit.padding(n, 2048) for n in totals) == 0
    whole = first_fit.packed(odd_docs, VOCABULARY, keep_ids=True, cut=False).collect()
    checked(whole, texts)
    assert all(r["length"] == 2048 or r["start"] + r["length"] == r["doc_tokens"] for r in whole)
    plain = first_fit.packed(odd_docs, VOCABULARY)
    assert plain.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kept = first_fit.packed(odd_docs, VOCABULARY, keep_ids=True).drop("ids")
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, kept.collect()))


def test_no_rows(no_docs):
    assert first_fit.packed(no_docs, VOCABULARY).count() == 0
