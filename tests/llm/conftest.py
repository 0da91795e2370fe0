import random

import pytest

#: Columns whose names the operators use inside.
CLASHES = "id long, key string, n int, low int, runs string, part int, rank int, bands string, component long, rows string"


def text_of(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def thue_morse(n: int, letters: str = "ab") -> str:
    """The first n letters of a sequence whose halves collide under polynomial sums modulo a power of two."""
    return "".join(letters[i.bit_count() % 2] for i in range(n))


@pytest.fixture(scope="session")
def twins():
    """Pairs of different texts that such sums can't tell apart: as one word, as words, and within a sentence."""
    out = []
    for n in (128, 256, 1024, 2048, 4096):
        one, two = thue_morse(n), thue_morse(n, "ba")
        out += [(one, two), (f"c{one}c", f"c{two}c"), (f"some words {one} and more", f"some words {two} and more"), (" ".join(one), " ".join(two))]
    return out


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, blanks, a very long text, repeats, near copies, shared passages, other scripts."""
    shared, base = text_of(1, 70), text_of(2, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (0, base), (1, " ".join(near)), (2, None), (3, ""), (4, " \n\t "), (5, "three short words"), (6, "Three SHORT words"), (7, text_of(3, 40) + " " + shared), (8, shared + "\n" + text_of(4, 60)),
        (9, text_of(5, 20_000)), (10, "naïve façade — 日本語のテキスト 🙂 " * 3), (11, base), (12, "x"), (13, "ab " * 300), (14, text_of(6, 200)), (15, "ré" * 150), (16, "ré" * 150 + "!"), (None, "no id at all"), (17, "one"), (18, "one"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    filler = (1, "k", 2, 3, "r", 4, 5, "b", 6, "w")
    rows = [(i, t, "en", "src", len(t) if t is not None else None, *filler) for i, t in odd_rows]
    rows.append(rows[14])  # a row that repeats
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)
