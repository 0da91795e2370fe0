import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from loomrank.llm import piece_codec
from loomrank.llm.queries import tokenizer

MODEL = tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def same(library, texts):
    codec = piece_codec.codec(MODEL)
    with np.errstate(over="ignore"):
        ids, many = codec.encode(texts)
        back = codec.decode(ids, many)
    at = np.concatenate([[0], np.cumsum(many)])
    for i, t in enumerate(texts):
        expected = library.encode(t)
        assert ids[at[i] : at[i + 1]].tolist() == expected, t[:80]
        assert back[i].decode() == library.decode(expected), t[:80]


def test_odd_texts(library):
    same(library, ["", " ", "  a", "a  b ", "\n", "a\tb", "▁a▁", "é日本🙂x", "\x00a", "ﬁ é ​", " " * 19 + "a", " " * 70, "a" * 500, "🏳️‍🌈", "没有空格的一段话。" * 40, "<s></s><unk><0x0A>"])


def test_random_texts(library):
    r = random.Random(4)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.get_piece_size())]
    same(library, ["".join(r.choice(pieces) for _ in range(r.randint(1, 40))) for _ in range(800)])
    same(library, ["".join(r.choice("aeinrst h  ") for _ in range(r.randint(1, 200))) for _ in range(800)])
    same(library, ["".join(chr(r.choice([r.randint(1, 0x2FF), r.randint(0x400, 0xD7FF), r.randint(0x10000, 0x1F9FF)])) for _ in range(60)) for _ in range(200)])


def test_texts_with_equal_fingerprints(library, twins):
    same(library, [x for pair in twins for x in pair])
    same(library, [x for pair in twins for x in pair[::-1]])
    codec = piece_codec.codec(MODEL)
    for one, two in twins:  # whatever a worker has seen before
        same(library, [two])
        same(library, [one])
    codec.seen.clear()
    codec.pool_size = codec.letters_size = 0
    codec.term, term = np.full_like(codec.term, 2), codec.term  # all stretches of one length share a fingerprint
    same(library, ["the cat sat on the mat", "tah cet sot an the mat", "hte"] + [x for pair in twins for x in pair])
    codec.term = term
    codec.seen.clear()
    codec.pool_size = codec.letters_size = 0


def test_neighbours_of_an_encoding_are_compatible(library):
    codec = piece_codec.codec(MODEL)
    r = random.Random(9)
    texts = ["".join(r.choice("aeinrstlo") for _ in range(12)) for _ in range(200)]
    for t in texts:
        ids = np.array(library.encode(t), np.int32)
        assert codec.compatible(ids[:-1], ids[1:]).all()


def test_odd_rows(odd_docs, odd_rows, library):
    got = {r["doc_id"]: r for r in piece_codec.encoded(odd_docs, MODEL).collect()}
    for i, t in odd_rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        r = got[i]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    real = {r["doc_id"]: r for r in piece_codec.encoded(odd_docs, MODEL, ids=True).collect()}
    assert real[10]["decoded"] == dict(odd_rows)[10] and real[3]["ids"] == [1, 2]


def test_no_rows(no_docs):
    assert piece_codec.encoded(no_docs, MODEL).count() == 0
