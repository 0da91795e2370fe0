"""SentencePiece BPE encoding by a prefix table, and decoding.

Merging always takes the best-scored adjacent pair, leftmost first.  A sequence
of tokens is a text's encoding exactly if every two neighbours are compatible:
encoded alone, their concatenation gives the same two tokens back (merges inside
two tokens run in the same order whatever surrounds them, so the first merge
across a border would also happen with the two alone).  Hence every prefix of a
text has one last token.  The encoder walks an automaton over all pieces, tries
the pieces that end at each position, longest first, keeps the one compatible
with the last token of the prefix before it, and reads the ids backwards.

Text is first cut where no piece has the two characters side by side; no token
crosses such a cut.  Most stretches occur many times, so each batch encodes its
distinct unseen stretches only, all of them at once, one position a step.  Equal
stretches are found by a fingerprint and then compared character by character; one
that only shares another's fingerprint is encoded by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomrank.llm.bytescan import U64, gather, mix

#: Characters per batch, and what a worker remembers at most: stretches, and their characters.
CHUNK, MEMORY, LETTERS = 1 << 19, 400_000, 1 << 23
_PAIRS = 1 << 20
_SPACE = 0x2581
_BASE = 0x9E3779B97F4A7C15
_codecs: dict[str, PieceCodec] = {}


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bos, self.eos = model.bos_id(), model.eos_id()
        special = [i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)]
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        skip = {*special, *self.byte_ids.tolist()}
        pieces = {i: model.id_to_piece(i) for i in range(n) if i not in skip}
        _, rank = np.unique(-np.array([model.get_score(i) for i in range(n)]), return_inverse=True)
        self._decoding(model, n, special)
        self._tables(pieces, rank.astype(np.int32), n)
        self.seen: dict[int, int] = {}
        self.pool, self.pool_size = np.zeros(1 << 16, np.int32), 0
        self.letters, self.letters_size = np.zeros(1 << 16, np.uint32), 0
        self.first, self.many = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.letter_at, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.term = mix(np.arange(0x110000, dtype=U64) + U64(77)) | U64(1)
        self.up = np.ones(1, U64)
        self.down = np.ones(1, U64)

    def _decoding(self, model, n: int, special: list[int]) -> None:
        whole = []
        for i in range(n):
            p = model.id_to_piece(i)
            whole.append(b"" if i in special else bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(chr(_SPACE), " ").encode())
        self.byte_len = np.array([len(x) for x in whole], np.int64)
        self.byte_at = np.cumsum(self.byte_len) - self.byte_len
        self.bytes = np.frombuffer(b"".join(whole), np.uint8)

    def _tables(self, pieces: dict[int, str], rank: np.ndarray, n: int) -> None:
        ids = {p: i for i, p in pieces.items()}
        chars = sorted({c for p in pieces.values() for c in p})
        self.cls = np.zeros(0x110000, np.int16)
        self.cls[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        number = {c: i + 1 for i, c in enumerate(chars)}
        beside = np.zeros((self.width, self.width), bool)
        for p in pieces.values():
            for a, b in pairwise(p):
                beside[number[a], number[b]] = True
        self.beside = beside.reshape(-1)
        # merges of every piece that merging can build: ranks in order, and the outermost parts after each
        steps = max(len(p) for p in pieces.values())
        big = np.int32(2**31 - 1)
        self.next_rank = np.full((n, steps), big, np.int32)
        self.right_part, self.left_part = np.zeros((n, steps), np.int32), np.zeros((n, steps), np.int32)
        self.length = np.zeros(n, np.int32)
        built = {}
        for i, p in pieces.items():
            parts, log = [ids.get(c, -1) for c in p], []
            names = list(p)
            log.append((parts[0], parts[-1]))
            ranks = []
            while len(names) > 1:
                best = min(((rank[j], k, j) for k, (a, b) in enumerate(pairwise(names)) if (j := ids.get(a + b)) is not None), default=None)
                if best is None:
                    break
                r, k, j = best
                names[k : k + 2], parts[k : k + 2] = [names[k] + names[k + 1]], [j]
                ranks.append(r)
                log.append((parts[0], parts[-1]))
            if len(names) == 1 and parts[0] >= 0:
                built[p] = i
                self.length[i] = len(p)
                self.next_rank[i, : len(ranks)] = ranks
                self.left_part[i, : len(log)], self.right_part[i, : len(log)] = zip(*log, strict=True)
        pairs = [(ids[p[:k]] * n + ids[p[k:]], rank[i]) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        pairs.sort()
        self.pair_key = np.array([k for k, _ in pairs], np.int64)
        self.pair_rank = np.array([r for _, r in pairs], np.int32)
        self.n = n
        self._automaton(built, number)
        self.known, self.verdict = np.full(_PAIRS, -1, np.int64), np.zeros(_PAIRS, bool)

    def _automaton(self, built: dict[str, int], number: dict[str, int]) -> None:
        """A trie with failure links; each state knows the longest piece that ends there."""
        nodes: list[dict[str, int]] = [{}]
        own = [-1]
        for p, i in built.items():
            at = 0
            for c in p:
                if c not in nodes[at]:
                    nodes[at][c] = len(nodes)
                    nodes.append({})
                    own.append(-1)
                at = nodes[at][c]
            own[at] = i
        fail, longest = [0] * len(nodes), own[:]
        self.shorter = np.full(self.n, -1, np.int32)
        queue = list(nodes[0].values())
        for at in queue:
            if own[at] < 0:
                longest[at] = longest[fail[at]]
            else:
                self.shorter[own[at]] = longest[fail[at]]
            for c, to in nodes[at].items():
                f = fail[at]
                while f and c not in nodes[f]:
                    f = fail[f]
                fail[to] = nodes[f].get(c, 0)
                queue.append(to)
        edges = sorted((at * self.width + number[c], to) for at, node in enumerate(nodes) for c, to in node.items())
        self.edge_key = np.array([k for k, _ in edges], np.int64)
        self.edge_to = np.array([t for _, t in edges], np.int32)
        self.fail, self.longest = np.array(fail, np.int32), np.array(longest, np.int32)

    def _move(self, state: np.ndarray, cls: np.ndarray) -> np.ndarray:
        out = np.zeros(len(state), np.int32)
        left = np.arange(len(state))
        while len(left):
            key = state[left].astype(np.int64) * self.width + cls[left]
            k = np.minimum(np.searchsorted(self.edge_key, key), len(self.edge_key) - 1)
            hit = self.edge_key[k] == key
            out[left[hit]] = self.edge_to[k[hit]]
            left = left[~hit & (state[left] > 0)]
            state[left] = self.fail[state[left]]
        return out

    def compatible(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether merging one + two alone gives one and two back."""
        key = one.astype(np.int64) * self.n + two
        slot = ((key * 0x9E3779B1) >> 7) & (_PAIRS - 1)
        new = np.flatnonzero(self.known[slot] != key)
        out = self.verdict[slot]
        if len(new):
            fresh, back = np.unique(key[new], return_inverse=True)
            said = self._tried((fresh // self.n).astype(np.int32), (fresh % self.n).astype(np.int32))
            out[new] = said[back]
            to = ((fresh * 0x9E3779B1) >> 7) & (_PAIRS - 1)
            to, last = np.unique(to, return_index=True)
            self.known[to], self.verdict[to] = fresh[last], said[last]
        return out

    def _tried(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out = np.ones(len(one), bool)
        i, j = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        left = np.arange(len(one))
        steps = self.next_rank.shape[1]
        big = np.int32(2**31 - 1)
        while len(left):
            a, b, x, y = one[left], two[left], i[left], j[left]
            key = self.right_part[a, x].astype(np.int64) * self.n + self.left_part[b, y]
            k = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            cross = np.where(self.pair_key[k] == key, self.pair_rank[k], big)
            mine, theirs = self.next_rank[a, np.minimum(x, steps - 1)], self.next_rank[b, np.minimum(y, steps - 1)]
            broken = (cross < mine) & (cross <= theirs) & (cross < big)
            over = (mine == big) & (theirs == big)
            out[left[broken]] = False
            first = mine <= theirs
            i[left], j[left] = x + first, y + ~first
            left = left[~broken & ~over]
        return out

    def _encode_new(self, cps: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches, one after another, and how many each has."""
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        n, total = len(start), int(length.sum())
        base = np.cumsum(length) - length
        last = np.zeros(total, np.int32)
        cls = self.cls[cps]
        state = np.zeros(n, np.int32)
        active, step = n, 0
        while active:
            c = cls[start[:active] + step]
            state[:active] = self._move(state[:active].copy(), c)
            token = self.longest[state[:active]].copy()
            open_ = np.flatnonzero(token >= 0)
            while len(open_):
                t = token[open_]
                before = step - self.length[t]
                edge = before < 0
                prev = np.where(edge, 0, last[base[open_] + np.maximum(before, 0)])
                fine = edge.copy()
                inner = np.flatnonzero(~edge & (prev >= 0))
                fine[inner] = self.compatible(prev[inner], t[inner])
                open_ = open_[~fine]
                token[open_] = self.shorter[token[open_]]
                open_ = open_[token[open_] >= 0]
            last[base[:active] + step] = token
            step += 1
            active = int(np.searchsorted(-length, -step, "left"))
        # backwards: mark the last character of each token
        ends = np.zeros(total, bool)
        at = length.astype(np.int64) - 1
        rows = np.arange(n)
        lone = np.flatnonzero(last[base] < 0)  # characters without a piece
        while len(rows):
            where = base[rows] + at[rows]
            ends[where] = True
            at[rows] -= np.where(last[where] >= 0, self.length[last[where]], 1)
            rows = rows[at[rows] >= 0]
        row_of = np.repeat(np.arange(n), length)
        counts = np.bincount(row_of[ends], minlength=n)
        ids = last[ends]
        if len(lone):  # each is a stretch of its own: its UTF-8 bytes' ids
            lists = np.split(ids, np.cumsum(counts)[:-1])
            for r in lone.tolist():
                lists[r] = self.byte_ids[list(chr(int(cps[start[r]])).encode("utf-8", "surrogatepass"))]
            counts = np.array([len(x) for x in lists])
            ids = np.concatenate(lists)
        first = np.cumsum(counts) - counts
        back = np.argsort(order, kind="stable")
        return gather(ids, first[back], counts[back]), counts[back]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts without begin and end, and how many each has."""
        size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        joined = "".join(chr(_SPACE) + t for t in texts if t)
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n = len(cps)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        cps[cps == 0x20] = _SPACE
        cls = self.cls[cps].astype(np.int64)
        cut = np.ones(n + 1, bool)
        cut[1:n] = ~self.beside[cls[:-1] * self.width + cls[1:]]
        text_at = np.cumsum(size) - size
        cut[text_at[size > 0]] = True
        start = np.flatnonzero(cut)
        start, length = start[:-1], np.diff(start)
        if len(self.up) <= n:
            m = max(n, CHUNK) + 1
            up, down = np.full(m, U64(_BASE), U64), np.full(m, U64(pow(_BASE, -1, 2**64)), U64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        prefix = np.zeros(n + 1, U64)
        np.cumsum(self.term[cps] * self.down[:n], out=prefix[1:])
        key = mix((prefix[start + length] - prefix[start]) * self.up[start] + length.astype(U64))
        keys, where, back = np.unique(key, return_index=True, return_inverse=True)
        if len(self.seen) > MEMORY or self.letters_size > LETTERS:
            self.seen.clear()
            self.pool_size = self.letters_size = 0
        slots = np.fromiter(map(self.seen.get, keys.tolist(), [-1] * len(keys)), np.int64, len(keys))
        new = np.flatnonzero(slots < 0)
        if len(new):
            s, n_new = start[where[new]], length[where[new]]
            ids, many = self._encode_new(cps, s, n_new)
            base = len(self.seen)
            slots[new] = base + np.arange(len(new))
            self.seen.update(zip(keys[new].tolist(), slots[new].tolist(), strict=True))
            for name in ("first", "many", "letter_at", "size"):
                setattr(self, name, _fitted(getattr(self, name), base + len(new)))
            self.first[slots[new]], self.many[slots[new]] = self.pool_size + np.cumsum(many) - many, many
            self.letter_at[slots[new]], self.size[slots[new]] = self.letters_size + np.cumsum(n_new) - n_new, n_new
            self.pool, self.pool_size = _appended(self.pool, self.pool_size, ids)
            self.letters, self.letters_size = _appended(self.letters, self.letters_size, gather(cps, s, n_new))
        slot = slots[back]
        first, many, pool = self.first[slot], self.many[slot].astype(np.int64), self.pool
        odd = self._mistaken(cps, slot, length)
        if len(odd):
            ids, own = self._encode_new(cps, start[odd], length[odd])
            first[odd], many[odd] = self.pool_size + np.cumsum(own) - own, own
            pool = np.concatenate([self.pool[: self.pool_size], ids])
        so_far = np.concatenate([[0], np.cumsum(many)])
        ends = np.searchsorted(start, text_at + size)
        begins = np.searchsorted(start, text_at)
        return gather(pool, first, many), np.where(size > 0, so_far[ends] - so_far[begins], 0)

    def _mistaken(self, cps: np.ndarray, slot: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The stretches whose characters aren't those of their slot; together all stretches are cps."""
        same = self.size[slot] == length
        fine = np.flatnonzero(same)
        if len(fine):
            own = cps if len(fine) == len(slot) else cps[np.repeat(same, length)]
            differ = gather(self.letters, self.letter_at[slot[fine]], length[fine]) != own
            if differ.any():
                same[fine] = np.add.reduceat(differ, np.cumsum(length[fine]) - length[fine]) == 0
        return np.flatnonzero(~same)

    def decode(self, ids: np.ndarray, many: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each run of ids (without the space that encoding puts first); bytes that form no character become U+FFFD."""
        n = self.byte_len[ids]
        data = gather(self.bytes, self.byte_at[ids], n).tobytes()
        so_far = np.concatenate([[0], np.cumsum(n)])
        at = np.concatenate([[0], np.cumsum(many)])
        out = []
        for a, b in pairwise(so_far[at].tolist()):
            x = data[a:b]
            x = x[1:] if x[:1] == b" " else x
            out.append(x.decode("utf-8", "replace").encode())
        return out


def _fitted(x: np.ndarray, n: int) -> np.ndarray:
    return x if len(x) >= n else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


def _appended(x: np.ndarray, n: int, more: np.ndarray) -> tuple[np.ndarray, int]:
    x = _fitted(x, n + len(more))
    x[n : n + len(more)] = more
    return x, n + len(more)


def codec(path: str) -> PieceCodec:
    if path not in _codecs:
        with np.errstate(over="ignore"):
            _codecs[path] = PieceCodec(path)
    return _codecs[path]


def _slices(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def encoded(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """Per document: number of ids (begin and end included), SHA-256 of the ids and of the decoded text, or the ids and the text themselves.

    Null and empty texts have the begin and end ids alone and decode to nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        with np.errstate(over="ignore"):
            for batch in batches:
                row = 0
                for texts in _slices([t or "" for t in batch.column(1).to_pylist()]):
                    flat, many = c.encode(texts)
                    names = batch.column(0)[row : row + len(texts)]
                    row += len(texts)
                    at = np.concatenate([[0], np.cumsum(many)])
                    back = c.decode(flat, many)
                    if ids:
                        full = [np.concatenate([[c.bos], flat[a:b], [c.eos]]) for a, b in pairwise(at)]
                        yield pa.RecordBatch.from_arrays([names, pa.array(full, pa.list_(pa.int32())), pa.array([x.decode() for x in back], pa.string())], ["doc_id", "ids", "decoded"])
                        continue
                    raw = flat.astype("<u4").tobytes()
                    head, tail = int(c.bos).to_bytes(4, "little"), int(c.eos).to_bytes(4, "little")
                    sums = [hashlib.sha256(b"".join((head, raw[4 * a : 4 * b], tail))).hexdigest() for a, b in pairwise(at.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [names, pa.array(many + 2, pa.int64()), pa.array(sums), pa.array([hashlib.sha256(x).hexdigest() for x in back])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                    )

    kind = "ids array<int>, decoded string" if ids else "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {kind}")
