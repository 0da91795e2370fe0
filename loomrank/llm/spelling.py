"""Words that differ by one code point, found by automata over halves of words, and grouped under their frequent form.

One edit touches one half of a word, so the other half stands unchanged at the same
end of any near word.  Each word is a pattern twice, once for each half that may
stay.  Patterns are dealt to shards by length, window and segment; a shard puts the
segments of its patterns into an Aho-Corasick automaton.  Every word is scanned by
the shards that its own ends and the three possible lengths lead to: a match counts
where the segment stands at its end and the lengths differ by at most one, and then
the parts around the edit are compared.

A segment that too many words share, such as a common ending, would be one long
list.  Its words' windows are halved again, until lists are short or the window is a
single code point; a pair is counted in one window only, so nothing is lost or
counted twice and the work stays in proportion to the words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrank.llm import scratch

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Patterns of a shard, about; patterns with the same segments beyond which windows are halved; words counted before a task passes them on.
SHARD, LIST, HELD = 30_000, 64, 1 << 17


def _counted(least: int, one_in: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, int] = defaultdict(int)

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own: dict[str, int] = defaultdict(int)
                for word, n in Counter(RUN.findall(text.as_py() or "")).items():
                    own[word.translate(_LOWER)] += n
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), start)
                    if h % one_in == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= least:
                        found[word] += n
                if len(found) > HELD:
                    yield passed()
        yield passed()

    return run


def words(docs: DataFrame, least: int = 5, times: int = 3, one_in: int = 97) -> DataFrame:
    """word and n: lower-cased runs of letters, with one code point deleted where `one_in` divides the checksum of id and run.

    Results shorter than `least` or seen fewer than `times` times are left out.
    Null texts have no runs; a null id stands as nothing before the colon.
    """
    parts = docs.select("doc_id", "text").mapInArrow(_counted(least, one_in), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def canonical(length: int, a: int, b: int, shared: int) -> bool:
    """Whether a pair that shares so long a prefix belongs to this window: of all that fit it the one with the longest prefix."""
    half = length // 2
    low, high = (half, length) if half <= shared else (0, half)
    while (low, high) != (a, b):
        if not (low <= a and b <= high) or high - low < 2:
            return False
        middle = (low + high) // 2
        low, high = (middle, high) if middle <= shared else (low, middle)
    return True


def one_apart(x: str, y: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes the two equal; equal ones aren't."""
    i, least = 0, min(len(x), len(y))
    while i < least and x[i] == y[i]:
        i += 1
    if len(x) == len(y):
        return i < least and x[i + 1 :] == y[i + 1 :]
    if len(x) > len(y):
        x, y = y, x
    return len(y) == len(x) + 1 and x[i:] == y[i + 1 :]


def _scanned(patterns: pa.Table, scanned: pa.Table) -> pa.Table:
    """word, n_near and the best near word of one shard."""
    import ahocorasick

    lists: dict[tuple[int, int, int, str, str], list[tuple[str, int]]] = defaultdict(list)
    for word, n, a, b in zip(*(patterns.column(c).to_pylist() for c in ("word", "n", "a", "b")), strict=True):
        lists[len(word), a, b, word[:a], word[b:]].append((word, n))
    segments: dict[str, list[tuple]] = defaultdict(list)
    for (length, a, b, prefix, suffix), own in lists.items():
        first = len(prefix) >= len(suffix)
        segments[prefix if first else suffix].append((first, length, a, b, prefix, suffix, own))
    automaton = ahocorasick.Automaton()
    for segment, groups in segments.items():
        automaton.add_word(segment, (len(segment), groups))
    if segments:
        automaton.make_automaton()
    out: list[tuple[str, int, int, str]] = []
    for word in scanned.column("word").to_pylist() if segments else ():
        size, near, best = len(word), 0, None
        for end, (long, groups) in automaton.iter(word):
            starts, ends = end + 1 == long, end + 1 == size
            if not (starts or ends):
                continue
            for first, length, a, b, prefix, suffix, own in groups:
                if not (starts if first else ends) or abs(length - size) > 1 or not word.startswith(prefix) or not word.endswith(suffix):
                    continue
                part = word[a : size - len(suffix)]
                for other, n in own:
                    if one_apart(other[a:b], part) and canonical(length, a, b, len(commonprefix((other, word)))):
                        near += 1
                        if best is None or (-n, other) < best:
                            best = (-n, other)
        if best:
            out.append((word, near, -best[0], best[1]))
    columns = list(zip(*out, strict=True)) if out else [()] * 4
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "near", "form_n", "form"])


_KEY = ["length", "a", "b", "head", "tail"]


def _ended(rows: DataFrame) -> DataFrame:
    """With what stands before and behind the window: a word of another length has its own tail."""
    return rows.withColumns({"head": F.expr("substring(word, 1, a)"), "tail": F.expr("substring(word, char_length(word) - (length - b) + 1, length - b)")})


def _windows(rows: DataFrame) -> DataFrame:
    """The two windows of a word of that length: its second and its first half."""
    half = F.floor(F.col("length") / 2).cast("int")
    second = F.struct(half.alias("a"), F.col("length").alias("b"))
    first = F.struct(F.lit(0).alias("a"), half.alias("b"))
    return _ended(rows.withColumn("w", F.explode(F.array(second, first))).select("*", "w.a", "w.b").drop("w"))


def _halved(rows: DataFrame, crowded: DataFrame) -> DataFrame:
    """Rows with a crowded key get the two halves of their window instead."""
    keyed = rows.join(crowded.withColumn("crowd", F.lit(True)), _KEY, "left")
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    whole = F.struct("a", "b")
    parts = F.array(F.struct(middle.alias("a"), F.col("b")), F.struct(F.col("a"), middle.alias("b")))
    kept = [c for c in rows.columns if c not in ("a", "b", "head", "tail")]
    halves = keyed.withColumn("w", F.explode(F.when(F.col("crowd"), parts).otherwise(F.array(whole))))
    return _ended(halves.select(*kept, "w.a", "w.b")).select(*rows.columns)


def near(vocabulary: DataFrame, shard: int = SHARD, most: int = LIST) -> DataFrame:
    """For every word of a stored table (word, n) that has near words: word, n_near, and the near one of largest n (ties: the smallest).

    A single code point has no halves, so such words are near nothing.
    """
    patterns = _windows(vocabulary.select("word", "n", F.char_length("word").alias("length"))).where("length > 1")
    lengths = F.explode(F.array(*(F.char_length("word") + d for d in (-1, 0, 1))))
    asked = _windows(vocabulary.select("word", lengths.alias("length")).where("length > 1"))
    # a word is only asked for where both ends of a window fit into it
    asked = asked.where("char_length(word) >= a + length - b")
    while True:
        patterns = scratch.saved(patterns, "patterns")
        crowded = scratch.saved(patterns.where("b - a > 1").groupBy(*_KEY).count().where(F.col("count") > most).select(*_KEY), "crowded")
        if crowded.isEmpty():
            break
        asked = scratch.saved(_halved(asked, crowded).where("char_length(word) >= a + length - b"), "asked")
        patterns = _halved(patterns, crowded)
    shards = max(1, -(-patterns.count() // shard))
    number = F.pmod(F.xxhash64(*_KEY), F.lit(shards)).alias("shard")
    both = patterns.select(number, "word", "n", "a", "b").groupBy("shard").cogroup(asked.select(number, "word").distinct().groupBy("shard"))
    found = both.applyInArrow(_scanned, "word string, near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), "form"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.n")).alias("near_n"), F.col("best.form").alias("near_form"))


def _roots(forms: DataFrame) -> DataFrame:
    """form and root of every word that is some word's form: each step looks twice as far, and n doubles with every form, so steps are few."""
    targets = forms.select("form").distinct()
    links = scratch.saved(targets.join(forms.select(F.col("word").alias("form"), F.col("form").alias("root")), "form", "left"), "links")
    # words without a form of their own are their own roots
    links = links.select("form", F.coalesce("root", "form").alias("root"))
    while True:
        next_ = links.select(F.col("form").alias("root"), F.col("root").alias("further"))
        joined = links.join(next_, "root", "left").select("form", F.coalesce("further", "root").alias("root"), (F.coalesce("further", "root") != F.col("root")).alias("moved"))
        joined = scratch.saved(joined, "links")
        if joined.where("moved").isEmpty():
            return joined.select("form", "root")
        links = joined.select("form", "root")


def variants(vocabulary: DataFrame, ratio: int = 2, shard: int = SHARD, most: int = LIST) -> DataFrame:
    """word, n, form, root, n_near and form_n of a table (word, n) with distinct words.

    A word's form is its near word of largest n where that is at least `ratio` times
    the word's own; its root is where its forms lead.  An empty table gives no rows.
    """
    vocabulary = scratch.saved(vocabulary, "vocabulary")
    every = vocabulary.join(near(vocabulary, shard, most), "word", "left")
    chosen = F.col("near_n") >= ratio * F.col("n")
    rows = scratch.saved(every.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(chosen, F.col("near_form")).alias("form"), F.when(chosen, F.col("near_n")).alias("form_n")), "forms")
    roots = _roots(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(roots, "form", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
