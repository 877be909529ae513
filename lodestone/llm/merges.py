"""Byte-pair merging with segment trees over the ranks of adjacent pairs.

A tree's leaf ``p`` holds ``rank * size + p`` for the pair that begins at symbol ``p`` (or INF): the minimum at the
root is the lowest rank and, among equal ranks, the leftmost place. A merge changes three leaves, each renewed
along its path in O(log n). ``MergeTable.encode`` keeps many such trees as rows of one array and steps them together;
``MergeTable.encode_long`` works on one piece of any length.
"""

from __future__ import annotations

import json

import numpy as np

WIDE = 1 << 16  # more than any id
ROOM = (2, 6, 14, 30, 62)  # bytes of the pieces that share an array, whose rows have a column more at each end
SLOTS, SHIFT, MIX = 1 << 18, np.uint64(64 - 18), np.uint64(0x9E3779B97F4A7C15)


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeTable:
    """Vocabulary and ranked merges of a byte-level model; ``end`` is the mark of a word's last symbol."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        model = self.spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in self.spec["added_tokens"]}
        vocab, chars = model["vocab"], byte_alphabet()
        self.first = np.array([vocab[chars[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[chars[b] + self.end] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (i, vocab[a + b]) for i, (a, b) in reversed([*enumerate(pairs)])}
        keys = np.array([a * WIDE + b for a, b in self.ranks], np.int64)
        ranks = np.array([r for r, _ in self.ranks.values()], np.int64)
        self.result = np.zeros(len(pairs), np.int32)
        self.result[ranks] = [x for _, x in self.ranks.values()]
        self._hash(keys, ranks)
        self.none = len(pairs)
        bytes_of = {c: b for b, c in chars.items()}
        self.token_bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            body = token[: -len(self.end)] + " " if self.end and token.endswith(self.end) else token
            self.token_bytes[i] = bytes(bytes_of[c] if c in bytes_of else 32 for c in body)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()

    def _hash(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Open addressing by multiplication; ``probes`` is the longest way to a key."""
        self.slots = np.full(SLOTS + 64, -1, np.int64)
        self.slot_ranks = np.zeros(SLOTS + 64, np.int32)
        self.probes, left, offset = 0, np.arange(len(keys)), 0
        home = (keys.view(np.uint64) * MIX >> SHIFT).astype(np.int64)
        while len(left):
            at = home[left] + offset
            free = self.slots[at] < 0
            _, firsts = np.unique(at[free], return_index=True)
            put = left[free][firsts]
            self.slots[home[put] + offset], self.slot_ranks[home[put] + offset] = keys[put], ranks[put]
            left, offset = np.setdiff1d(left, put), offset + 1
        self.probes = offset

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``none`` where it never merges; symbol -1 merges with nothing."""
        key = a.astype(np.int64) * WIDE + b
        key[(a < 0) | (b < 0)] = -2
        out = np.full(key.shape, self.none, np.int32)
        flat, key = out.reshape(-1), key.reshape(-1)
        at = (key.view(np.uint64) * MIX >> SHIFT).astype(np.int64)
        todo = None
        for _ in range(self.probes):
            slot = self.slots.take(at)
            hit = slot == key
            if todo is None:
                flat[hit] = self.slot_ranks[at[hit]]
                todo = np.flatnonzero(~hit & (slot >= 0))
            else:
                flat[todo[hit]] = self.slot_ranks[at[hit]]
                todo = todo[~hit & (slot >= 0)]
            if not len(todo):
                break
            on = ~hit & (slot >= 0)
            key, at = key[on], at[on] + 1
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers; an empty piece has none."""
        out = np.full(len(pieces), b"", object)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for i in np.flatnonzero(lengths > ROOM[-1]).tolist():
            out[i] = np.array(self.encode_long(pieces[i]), "<u4").tobytes()
        which = np.searchsorted(ROOM, lengths)
        which[lengths == 0] = -1
        for k, room in enumerate(ROOM):
            members = np.flatnonzero(which == k)
            for a in range(0, len(members), 8192):
                part = members[a : a + 8192]
                out[part] = np.array(self._rows([pieces[i] for i in part.tolist()], room + 2), object)
        return out.tolist()

    def _rows(self, pieces: list[bytes], size: int) -> list[bytes]:
        # columns: 0 is the left end, 1..n the symbols, what follows the right end
        w, none = len(pieces), self.none * size
        n = np.fromiter(map(len, pieces), np.int64, w)
        raw = np.array(pieces, f"S{size - 2}").view(np.uint8).reshape(w, size - 2)
        sym = np.full((w, size), -1, np.int32)
        sym[:, 1:-1] = self.first[raw]
        rows = np.arange(w)
        sym[rows, n] = self.last[raw[rows, n - 1]]
        column = np.arange(size)
        alive = (column >= 1) & (column <= n[:, None])
        sym[~alive] = -1
        nxt = np.tile(np.minimum(column + 1, size - 1), (w, 1))
        prv = np.tile(np.maximum(column - 1, 0), (w, 1))
        tree = np.full((w, 2 * size), none, np.int32)
        tree[:, size : 2 * size - 1] = self.rank(sym[:, :-1], sym[:, 1:]) * size + column[:-1]
        half = size
        while half > 1:
            half //= 2
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
        # flat views: place ``row * size + column`` of the arrays, ``2 * row * size + node`` of the trees
        sym_, nxt_, prv_, alive_, tree_ = (x.reshape(-1) for x in (sym, nxt, prv, alive, tree))
        live = rows[tree[:, 1] < none] * size
        while len(live):
            root = tree_.take(2 * live + 1)
            rank = root // size
            at = root - rank * size
            place = live + at
            right = nxt_.take(place)
            after, before = nxt_.take(live + right), prv_.take(place)
            new = self.result.take(rank)
            sym_[place] = new
            sym_[live + right] = -1
            alive_[live + right] = False
            nxt_[place] = after
            prv_[live + after] = at
            base = 2 * live
            both = self.rank(np.concatenate([new, sym_.take(live + before)]), np.concatenate([sym_.take(live + after), new])) * size
            tree_[base + size + right] = none
            tree_[base + size + at] = both[: len(live)] + at
            tree_[base + size + before] = both[len(live) :] + before
            for leaf in (right, at, before):
                i = (size + leaf) >> 1
                while True:
                    child = base + 2 * i
                    tree_[base + i] = np.minimum(tree_.take(child), tree_.take(child + 1))
                    if i[0] == 1:
                        break
                    i >>= 1
            live = live[tree_.take(base + 1) < none]
        flat = sym[alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def encode_long(self, piece: bytes) -> list[int]:
        """The same for one piece of any length, with one tree in a list."""
        n, ranks = len(piece), self.ranks
        if not n:
            return []
        sym = [int(x) for x in self.first[np.frombuffer(piece, np.uint8)]]
        sym[-1] = int(self.last[piece[-1]])
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        size = 1
        while size < n:
            size *= 2
        big = (self.none + 1) * size
        tree = [big] * (2 * size)

        def key(p: int) -> int:
            q = nxt[p]
            got = ranks.get((sym[p], sym[q])) if q >= 0 else None
            return got[0] * size + p if got else big

        for p in range(n):
            tree[size + p] = key(p)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(p: int, k: int) -> None:
            i = size + p
            tree[i] = k
            i >>= 1
            while i:
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    break
                tree[i] = low
                i >>= 1

        while n > 1 and tree[1] < big:
            p = tree[1] % size
            q = nxt[p]
            sym[p] = ranks[sym[p], sym[q]][1]
            nxt[p] = nxt[q]
            if nxt[q] >= 0:
                prv[nxt[q]] = p
            sym[q] = -1
            put(q, big)
            put(p, key(p))
            if prv[p] >= 0:
                put(prv[p], key(prv[p]))
        return [s for s in sym if s >= 0]
