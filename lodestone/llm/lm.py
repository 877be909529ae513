"""LM scoring (operator 2): Ziv-Merhav cross-parsing against all labelled good text.

A document is cut, from the left, into the longest phrases that occur in the reference; the fewer phrases it needs, the
closer the document is to the reference. The score is the Ziv-Merhav estimate of relative entropy per symbol:
``(c log2 n - d log2 d) / n``, with n symbols (lower-case words), c cross-phrases, and d phrases of the document's own
incremental parse.

The reference is the text of every labelled good document but the document itself. One automaton over a reference that
grows with the corpus fits no task, so the factors of the reference are looked up by hash. A match's length is exact, however
long it is:

* Factors of 2, 3 and 4 words are looked up at every place whose pairs are known. A single word is a phrase whether the
  reference holds it or not.
* The end of the longest match never moves left from one place to the next, and it moves right only where the match's other
  occurrence has another word before it. So longer factors are looked up only at starts: places whose factor of four words has
  different words, or the start of a text, before it. The other places inherit the end of the place before.
* A start's factors of 5, 6, 7, 8, 16, 32, ... words are looked up first, then eighths of the stretch of lengths in which its own
  match ends. Good texts also look up the stretches along which the number of starts that wait for an answer falls: there
  another start's match may end at them. Where two starts agree their stretches have the same ends, so whatever one text asks
  for the good texts offer. Starts of other texts ask for nothing but their own matches.

The result depends on neither blocks nor partitions nor the size of the table.

Texts are cut into batches of words. Each batch sends its different factors, sorted and as differences of 56-bit hashes, to the
shards that own their ranges, and gets back four bits for each, and for starts the number of holders. Pairs of words go first;
a longer factor is sent only where all its pairs, or all its factors of four words, are known to another document.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, freed, saved, ship, small_batches, take

#: Lengths of the factors that are looked up at every place; pairs go first.
LADDER = (2, 3, 4)
#: Into how many parts a stretch of lengths is cut.
PARTS = 8
BITS = 56
IN_REFERENCE, MANY_GOOD, MANY = 1, 2, 4


def symbols(text: str) -> list[str]:
    """Lower-case words."""
    return text.lower().split()


def own_phrases(words: list) -> int:
    """Phrases of the incremental parse: each is the shortest that was not met before; the last may be one that was."""
    tree: dict = {}
    get, at, count = tree.get, 0, 0
    for w in words:
        step = at, w
        to = get(step)
        if to is None:
            count += 1
            tree[step] = count
            at = 0
        else:
            at = to
    return count + (at != 0)


def relative_entropy(n: int, cross: int, own: int) -> float | None:
    """Bits per symbol; None for a text without symbols."""
    return None if not n else (cross * math.log2(n) - own * math.log2(max(1, own))) / n


def planes(x: np.ndarray) -> bytes:
    """The bytes of integers, all the lowest first: high bytes of small numbers are zero and compress to nothing."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def integers(planed: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planed, np.uint8).reshape(size, -1).T).view(kind).ravel()


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def factors_at(one: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of the factor of so many words at each of the places ``at`` of the words' hashes ``one``, by windows of powers of two."""
    h, place, window, k = length.astype(np.uint64), at.astype(np.int64), one, 0
    top = int(length.max(initial=0)).bit_length()
    for k in range(top):
        use = np.flatnonzero(length >> k & 1)
        h[use] = mixed(h[use], window[place[use]])
        place[use] += 1 << k
        if k + 1 < top:
            window = mixed(window, np.roll(window, -(1 << k)))  # what comes round from the start lies beyond any factor
    return h >> np.uint64(64 - BITS)


def ranked(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes, sorted, and the place of each among them, by sorting one number: the hash's first bits and its place."""
    n = len(h)
    if n < 2:
        return h.copy(), np.zeros(n, np.int64)
    bits, low = (n - 1).bit_length(), h.min()
    spare = max(0, 64 - int(h.max() - low).bit_length())
    mask = np.uint64((1 << bits) - 1)
    key = (h - low) << np.uint64(min(spare, 63))
    key &= ~mask
    key |= np.arange(n, dtype=np.uint64)
    key.sort()
    order = (key & mask).view(np.int64)
    found = h[order]
    wrong = np.flatnonzero(found[1:] < found[:-1])
    if len(wrong):  # the first bits agree, the rest do not
        key >>= np.uint64(bits)
        ends = {(np.searchsorted(key, k), np.searchsorted(key, k, "right")) for k in key[wrong]}
        for a, b in ends:
            part = order[a:b]
            order[a:b] = part[np.argsort(h[part])]
        found = h[order]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(found[1:], found[:-1], out=new[1:])
    which = np.empty(n, np.int64)
    which[order] = np.cumsum(new) - 1
    return found[new], which


def different(h: np.ndarray, text: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different factors, sorted, the place of each among them, and a good text of each or -1."""
    found, which = ranked(h)
    owner = np.full(len(found), -1, np.int32)
    owner[which[good]] = text[good]
    return found, which, owner


def flags_of(found: np.ndarray, which: np.ndarray, owner: np.ndarray, text: np.ndarray, good: np.ndarray) -> np.ndarray:
    flags = (owner >= 0) * np.uint8(IN_REFERENCE)
    one = np.zeros(len(found), np.int32)
    one[which] = text
    flags[which[text != one[which]]] |= MANY
    flags[which[good & (text != owner[which])]] |= MANY_GOOD
    return flags


def same_or_zero(which: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The one value of each of ``n`` groups; zero if there are several or one is zero."""
    first = np.zeros(n, value.dtype)
    first[which] = value
    several = np.bincount(which, (value != first[which]) | (value == 0), n) > 0
    return np.where(several, value.dtype.type(0), first)


def pickled(x: object) -> bytes:
    """Compressed: between steps these bytes are copied by the JVM several times."""
    plain = pickle.dumps(x)
    return len(plain).to_bytes(8, "little") + pa.compress(plain, "zstd", asbytes=True)


def unpickled(x: bytes) -> object:
    return pickle.loads(pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True))


class Batch:
    """Words of several texts in a row: ``words`` numbers a vocabulary of hashes; ``good`` tells which texts are reference."""

    def __init__(self, words: np.ndarray, hashes: np.ndarray, lengths: np.ndarray, good: np.ndarray):
        self.words, self.lengths = words, lengths
        self.text = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        self.left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(words))  # words from here to the end of the text
        self.good = good[self.text]
        self.one = hashes[words]
        self._grown, self._n = self.one, 1

    def factors(self, n: int) -> np.ndarray:
        """Hash of the factor of ``n`` words at each place; called with growing ``n``. Meaningless where ``left < n``."""
        h = self._grown
        while self._n < n:
            # the factor's other words are at later places; what comes round from the start lies beyond ``left``
            h = mixed(h, np.roll(self.one, -self._n))
            self._n += 1
        self._grown = h
        return h >> np.uint64(64 - BITS)

    def different(self, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return different(self.factors(n)[at], self.text[at], self.good[at])

    def request(self, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different factors at the places ``at``, sorted, the flags of each, and for the longest of the ladder the word before or 0."""
        found, which, owner = self.different(n, at)
        flags = flags_of(found, which, owner, self.text[at], self.good[at])
        if n < LADDER[-1]:
            return found, flags, np.zeros(0, np.uint32)
        before = np.maximum(self.one[at - 1] >> np.uint64(32), np.uint64(1)).astype(np.uint32)
        before[self.left[at] == self.lengths[self.text[at]]] = 0  # a text's start is like no other
        return found, flags, same_or_zero(which, before, len(found))


class Starts:
    """Starts of one batch, the words that their matches can reach, and what is still to be looked up.

    ``one`` holds the hashes of these words; a start has its place there, its place in the batch (``origin``), its text, whether
    that is good, how far a match can reach and the longest length known (``best``). A stretch has a start, a length that
    some other text holds and a longer one (``low``, ``high``), and whether the start's own match ends in it (``own``); if not, it
    is there for others.
    """

    ARRAYS = "one place origin text good reach best start low high own".split()

    def __init__(self, first: bool, **arrays: np.ndarray):
        self.first = first
        for name in self.ARRAYS:
            setattr(self, name, arrays[name])

    @classmethod
    def of(cls, b: Batch, known: np.ndarray, active: np.ndarray, several: np.ndarray) -> Starts:
        """From the places whose longest factor of the ladder is known, is worth a look, and has several words before it."""
        room = run_lengths(active) + LADDER[-1] - 1
        at = np.flatnonzero(active & several & (room > LADDER[-1]))
        reach = room[at].astype(np.int64)
        edges = np.bincount(at, minlength=len(b.words) + 1) - np.bincount(at + reach, minlength=len(b.words) + 1)
        kept = np.cumsum(edges)[:-1] > 0
        n = len(at)
        grid = cls.grid(int(reach.max(initial=0)))
        return cls(True, one=b.one[kept], place=(np.cumsum(kept) - 1)[at], origin=at, text=b.text[at], good=b.good[at], reach=reach,
            best=np.where(known[at], LADDER[-1], 1).astype(np.int64), start=np.arange(n), low=np.full(n, LADDER[-1]),
            high=grid[np.searchsorted(grid, reach, "right")], own=known[at])

    @staticmethod
    def grid(reach: int) -> np.ndarray:
        """Lengths of the first look-up, to the first beyond the reach: each up to 8, then powers of two."""
        out = [*range(LADDER[-1] + 1, PARTS + 1)]
        while out[-1] <= reach:
            out.append(2 * out[-1])
        return np.array(out, np.int64)

    def asks(self) -> tuple[np.ndarray, np.ndarray]:
        """Stretches and lengths to be looked up, each stretch's in order, after the first time with its ``low``; none beyond a start's reach."""
        if not len(self.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.first:
            lengths = self.grid(int(self.reach.max()))[None, :]
        else:
            step = np.maximum((self.high - self.low) // PARTS, 1)
            lengths = self.low[:, None] + step[:, None] * np.arange(PARTS)
        which, k = np.nonzero(lengths < np.minimum(self.high, self.reach[self.start] + 1)[:, None])
        return which, lengths[0, k] if self.first else lengths[which, k]

    def request(self) -> tuple[np.ndarray, ...]:
        """The asked stretches and lengths; different factors, sorted, and the place of each, an owner, flags, the number of holders
        that wait for an answer (the first time, all)."""
        stretch, length = self.asks()
        start = self.start[stretch]
        text, good = self.text[start], self.good[start]
        found, which, owner = different(factors_at(self.one, self.place[start], length), text, good)
        held = np.bincount(which, None if self.first else self.own[stretch], len(found))
        return stretch, length, found, which, owner, flags_of(found, which, owner, text, good), np.minimum(held, 0xFFFFFFFF).astype(np.uint32)

    def narrowed(self, stretch: np.ndarray, length: np.ndarray, known: np.ndarray, count: np.ndarray) -> None:
        """Take in the answers, and keep the part of each stretch in which the start's match ends, and of good texts those along which
        the number of waiting holders falls."""
        n = len(self.start)
        ends = np.arange(n)
        beyond = np.zeros(0, np.int64)
        np.maximum.at(self.best, self.start[stretch[known]], length[known])
        if self.first:
            seq, at = np.concatenate([ends, stretch, ends]), np.concatenate([self.low, length, self.high])
            counts = np.concatenate([np.full(n, np.iinfo(np.int64).max), count, np.zeros(n, np.int64)])
            knows = np.concatenate([self.own, known, np.zeros(n, bool)])
        else:
            # lengths beyond the reach were not asked for: the first of them ends the last part, as it would had it been asked for
            step = np.maximum((self.high - self.low) // PARTS, 1)
            last = self.low + step * (np.bincount(stretch, minlength=n) - 1)
            beyond = np.flatnonzero(last + step < self.high)
            none = np.zeros(len(beyond) + n, np.int64)
            seq, at = np.concatenate([stretch, beyond, ends]), np.concatenate([length, (last + step)[beyond], self.high])
            counts, knows = np.concatenate([count, none]), np.concatenate([known & self.own[stretch], none > 0])
        order = np.argsort(seq, kind="stable")  # each stretch's lengths are in order
        seq, at, counts, knows = seq[order], at[order], counts[order], knows[order]
        inner = (seq[1:] == seq[:-1]) & (np.diff(at) > 1)
        own = knows[:-1] & ~knows[1:]
        open_ = np.flatnonzero(inner & (own | self.good[self.start[seq[:-1]]] & (counts[:-1] > counts[1:])))
        start, own = self.start[seq[open_]], own[open_]
        # of the stretches that are there for others one stands for all equal ones of a text
        serves = np.flatnonzero(~own & (at[open_ + 1] <= self.reach[start]))
        high = factors_at(self.one, self.place[start[serves]], at[open_ + 1][serves])
        key = mixed(mixed(high, at[open_][serves].astype(np.uint64)), self.text[start[serves]].astype(np.uint64)) >> np.uint64(64 - BITS)
        found, which = ranked(key)
        one = np.zeros(len(found), np.int64)
        one[which] = serves
        stays = np.ones(len(open_), bool)
        stays[serves] = False
        stays[one] = True
        k = open_[stays]
        self.first, self.start, self.own, self.low, self.high = False, start[stays], own[stays], at[k], at[k + 1]

    def dump(self) -> bytes:
        vocabulary, numbers = np.unique(self.one, return_inverse=True)
        rest = {n: getattr(self, n) for n in self.ARRAYS[1:]}
        small = {n: (x.dtype.str, planes(np.ascontiguousarray(x))) for n, x in rest.items()}
        return pickled((self.first, vocabulary.tobytes(), planes(numbers.astype(np.uint32)), small))

    @classmethod
    def load(cls, dumped: bytes) -> Starts:
        first, vocabulary, numbers, small = unpickled(dumped)
        return cls(first, one=np.frombuffer(vocabulary, np.uint64)[integers(numbers, np.uint32)], **{n: integers(x, kind).copy() for n, (kind, x) in small.items()})


def answers(found: list[np.ndarray], flags: list[np.ndarray], before: list[np.ndarray] | None = None, held: list[np.ndarray] | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each batch's factors: bit 0, in the reference by another text wherever in the batch it is met; bit 1, by one text of
    this batch alone; bit 2, some other text holds it, good or not; bit 3, several words are before it. And the sums of ``held``."""
    cuts = np.cumsum([len(x) for x in found])[:-1]
    distinct, at = ranked(np.concatenate(found))
    flag = np.concatenate(flags)
    inside = flag & IN_REFERENCE > 0
    batches, good = np.bincount(at), np.bincount(at, inside)
    many_good = np.bincount(at, flag & MANY_GOOD) > 0
    known = good[at] > 0
    alone = known & inside & (good[at] == 1) & ~many_good[at]
    other = (batches[at] > 1) | (flag & MANY > 0)
    code = (known & ~alone) * np.uint8(1) | alone * np.uint8(2) | other * np.uint8(4)
    if before is not None:
        code |= (same_or_zero(at, np.concatenate(before), len(distinct)) == 0)[at] * np.uint8(8)
    sums = [] if held is None else np.split(np.minimum(np.bincount(at, np.concatenate(held)), 0xFFFFFFFF).astype(np.uint32)[at], cuts)
    return np.split(code, cuts), sums


def packed(code: np.ndarray) -> bytes:
    return b"".join(np.packbits(code >> k & 1).tobytes() for k in range(4))


def unpacked(bits: bytes, n: int) -> np.ndarray:
    rows = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(4, -1), axis=1)[:, :n]
    return rows[0] | rows[1] << 1 | rows[2] << 2 | rows[3] << 3


def run_lengths(ok: np.ndarray) -> np.ndarray:
    """How many places in a row from each place on are true."""
    at = np.arange(len(ok), dtype=np.int32)
    ends = np.where(ok, np.int32(len(ok)), at)
    return np.minimum.accumulate(ends[::-1])[::-1] - at


def all_of(ok: np.ndarray, n: int) -> np.ndarray:
    """Places from which ``n`` places in a row are true."""
    return run_lengths(ok) >= n


def longest(length: np.ndarray) -> np.ndarray:
    """Length of the phrase at each place: no match ends before one that begins further left."""
    at = np.arange(len(length))
    return np.maximum.accumulate(at + length) - at


def phrases(length: np.ndarray, lengths: np.ndarray) -> list[int]:
    """Phrases of the greedy parse of each text."""
    step, out, at, end = (np.arange(len(length)) + length).tolist(), [], 0, 0
    for n in lengths.tolist():
        end += n
        count = 0
        while at < end:
            at = step[at]
            count += 1
        out.append(count)
    return out


def _shards(found: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's range of sorted hashes begins, and the end of the last."""
    return np.searchsorted(found, np.array([-(-(s << BITS) // shards) for s in range(shards + 1)], np.uint64))


def score(docs: DataFrame, good: DataFrame, batch: int = 1_000_000, shard: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_symbols, n_phrases, n_own_phrases, score`` of every row of ``docs``.

    The reference of a row is the texts of the rows of ``docs`` whose id is in ``good``, but for the row itself (a repeated row is
    another's reference). Null and empty texts have no symbols and a null score; a null id is never in the reference;
    repeated rows give a result each; with an empty reference each symbol is a phrase; an empty table gives no rows;
    other columns are not read. ``batch`` and ``shard`` are numbers of words: they bound memory, not the result.
    """
    spark = docs.sparkSession
    ship(spark)
    d = take(docs, id_col, text_col, into=("id", "text"))
    kind = d.schema["id"].dataType.simpleString()
    g = take(good, id_col, into=("id",)).select(F.col("id").cast(kind)).where("id IS NOT NULL").distinct().withColumn("good", F.lit(True))
    # by merging: labels grow with the corpus, so a broadcast that fits small ones would change the plan with the size
    joined = d.join(g.hint("merge"), "id", "left").select("id", "text", F.coalesce("good", F.lit(False)).alias("good"))

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, made, held = TaskContext.get().partitionId() << 32, 0, 0
        ids, flags, lengths, words = [], [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal made
            spelt = pa.chunked_array(words, pa.large_binary()).dictionary_encode().combine_chunks()
            spelt = spelt.chunk(0) if isinstance(spelt, pa.ChunkedArray) else spelt
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, spelt.dictionary.to_pylist()), np.uint64, len(spelt.dictionary))
            row = [number + made], [ids], [np.array(flags, bool).tobytes()], [planes(np.array(lengths, np.int64))], [planes(spelt.indices.to_numpy().astype(np.uint32))], [hashes.tobytes()], [sum(lengths)]
            types = pa.int64(), pa.list_(id_type), *[pa.binary()] * 4, pa.int64()
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], ["batch", "ids", "good", "lengths", "words", "hashes", "n"])
            made += 1
            for x in (ids, flags, lengths, words):
                x.clear()
            return out

        for whole in batches:
            id_type = whole.column(0).type
            for part in small_batches(whole, "text"):
                for key, text, flag in zip(*(part.column(i).to_pylist() for i in range(3))):
                    own = symbols(text or "")
                    ids.append(key)
                    flags.append(flag)
                    lengths.append(len(own))
                    words.append(pa.array(own, pa.large_string()).cast(pa.large_binary()))
                    held += len(own) + 1
                    if held >= batch:
                        yield flush()
                        held = 0
        if ids:
            yield flush()

    table = saved(joined.mapInArrow(tokenised, f"batch bigint, ids array<{kind}>, good binary, lengths binary, words binary, hashes binary, n bigint"), "words")
    freed(spark)
    shards = max(1, math.ceil((table.agg(F.sum("n")).first()[0] or 0) / shard))

    def loaded(row: dict) -> Batch:
        return Batch(integers(row["words"], np.uint32), np.frombuffer(row["hashes"], np.uint64), integers(row["lengths"], np.int64), np.frombuffer(row["good"], bool))

    def requests(rows: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for number, n, found, flags, more in rows:
            edges = _shards(found, shards)
            for s in np.flatnonzero(np.diff(edges)).tolist():
                a, b = edges[s], edges[s + 1]
                row = [n * shards + s], [number], [n], [s], [planes(np.diff(found[a:b], prepend=np.uint64(0)))], [flags[a:b].tobytes()], [planes(more[a:b])]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, asked_types)], asked_names)

    asked = "at bigint, batch bigint, n int, s bigint, found binary, flags binary, more binary"
    asked_names, asked_types = [x.split()[0] for x in asked.split(", ")], (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())

    def answer(rows: pa.Table) -> pa.Table:
        n = rows.column("n")[0].as_py()
        found = [np.cumsum(integers(x, np.uint64), dtype=np.uint64) for x in rows.column("found").to_pylist()]
        more = [integers(x, np.uint32) for x in rows.column("more").to_pylist()]
        codes, sums = answers(found, [np.frombuffer(x, np.uint8) for x in rows.column("flags").to_pylist()], more if n == LADDER[-1] else None, None if n else more)
        return pa.table([rows.column("batch"), rows.column("n"), rows.column("s"), pa.array([packed(c) for c in codes], pa.binary()), pa.array([planes(x) for x in sums] or [b""] * len(codes), pa.binary())], ["batch", "n", "s", "bits", "sums"])

    def answered(sent: DataFrame, name: str) -> DataFrame:
        out = saved(sent.groupBy("at").applyInArrow(answer, "batch bigint, n int, s bigint, bits binary, sums binary"), name)
        freed(spark)
        return out

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for rows in batches:
            for k in range(rows.num_rows):
                yield rows.slice(k, 1).to_pylist()[0]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            b = loaded(row)
            yield from requests([(row["batch"], 2, *b.request(2, np.flatnonzero(b.left >= 2)))])

    def told(found: np.ndarray, which: np.ndarray, n: int, bits: dict) -> tuple[np.ndarray, np.ndarray]:
        """The answer of each place, and its sum if there is any."""
        edges = _shards(found, shards)
        parts = [(s, edges[s + 1] - edges[s]) for s in np.flatnonzero(np.diff(edges)).tolist()]
        code = np.concatenate([np.zeros(0, np.uint8), *(unpacked(bits[n, s][0], size) for s, size in parts)])
        sums = np.concatenate([np.zeros(0, np.uint32), *(integers(bits[n, s][1], np.uint32) for s, _ in parts)])
        return code[which], sums[which] if len(sums) else sums

    def heard(b: Batch, n: int, at: np.ndarray, bits: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places where the factor of ``n`` words is in the reference without this text, those where some other text has it, and
        those where several words are before it."""
        found, which, owner = b.different(n, at)
        code, _ = told(found, which, n, bits)
        known, shared, several = (np.zeros(len(b.words), bool) for _ in range(3))
        known[at] = (code & 1 > 0) | (code & 2 > 0) & (owner[which] != b.text[at])
        shared[at] = code & 4 > 0
        several[at] = code & 8 > 0
        return known, shared, several

    def places(b: Batch, n: int, known: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Where a factor of more than two words can be known, or be known to others by this text."""
        return np.flatnonzero((b.left >= n) & (all_of(known, n - 1) | b.good & all_of(shared, n - 1)))

    def by_place(rows: pa.Table) -> dict:
        return {(n, s): (bits, sums) for n, s, bits, sums in zip(*(rows.column(c).to_pylist() for c in ("n", "s", "bits", "sums")))}

    def longer(words: pa.Table, bits: pa.Table) -> pa.Table:
        sent = []
        for row in words.to_pylist():
            b = loaded(row)
            known, shared, _ = heard(b, 2, np.flatnonzero(b.left >= 2), by_place(bits))
            for n in LADDER[1:]:
                sent.extend(requests([(row["batch"], n, *b.request(n, places(b, n, known, shared)))]))
        return pa.Table.from_batches(sent) if sent else pa.table([pa.array([], t) for t in asked_types], asked_names)

    kept = f"batch bigint, ids array<{kind}>, stretches bigint, parse binary, starts binary"

    def started(words: pa.Table, bits: pa.Table) -> pa.Table:
        """What is left of a batch once short factors are answered: no text, and of the words those that starts reach."""
        got, out = by_place(bits), []
        for k, row in enumerate(words.to_pylist()):
            b = loaded(row)
            known, shared, _ = heard(b, 2, np.flatnonzero(b.left >= 2), got)
            short = 1 + known.astype(np.uint8)
            at = {n: places(b, n, known, shared) for n in LADDER[1:]}
            for n in LADDER[1:]:
                known, shared, several = heard(b, n, at[n], got)
                short[known] = n
            starts = Starts.of(b, known, known | b.good & shared, several)
            numbers, own, end = b.words.tolist(), [], 0
            for n in b.lengths.tolist():
                own.append(own_phrases(numbers[end : end + n]))
                end += n
            made = [len(starts.start)], [pickled((short, np.array(own, np.int64), b.lengths))], [starts.dump()]
            out.append(pa.table([words.column("batch").slice(k, 1), words.column("ids").slice(k, 1), *(pa.array(x, t) for x, t in zip(made, (pa.int64(), pa.binary(), pa.binary())))], [x.split()[0] for x in kept.split(", ")]))
        return pa.concat_tables(out)

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            _, _, found, _, _, flags, held = Starts.load(row["starts"]).request()
            yield from requests([(row["batch"], 0, found, flags, held)])

    def narrowed(rows: pa.Table, bits: pa.Table) -> pa.Table:
        got, counts, dumps = by_place(bits), [], []
        for dumped in rows.column("starts").to_pylist():
            starts = Starts.load(dumped)
            if len(starts.start):
                stretch, length, found, which, owner, _, _ = starts.request()
                code, sums = told(found, which, 0, got)
                start = starts.start[stretch]
                known = (code & 1 > 0) | (code & 2 > 0) & (owner[which] != starts.text[start])
                starts.narrowed(stretch, length, known, np.where(known | starts.good[start] & (code & 4 > 0), sums.astype(np.int64), 0))
            counts.append(len(starts.start))
            dumps.append(starts.dump())
        return rows.set_column(2, "stretches", pa.array(counts, pa.int64())).set_column(4, "starts", pa.array(dumps, pa.binary()))

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k in range(rows.num_rows):
                row = rows.slice(k, 1)
                (short, own, sizes), starts = (f(row.column(c)[0].as_py()) for c, f in ((3, unpickled), (4, Starts.load)))
                length = short.astype(np.int64)
                length[starts.origin] = np.maximum(length[starts.origin], starts.best)
                cross = phrases(longest(length), sizes)
                sizes, own = sizes.tolist(), own.tolist()
                scores = [relative_entropy(*x) for x in zip(sizes, cross, own)]
                yield pa.RecordBatch.from_arrays([row.column(1).flatten(), pa.array(sizes, pa.int64()), pa.array(cross, pa.int64()), pa.array(own, pa.int64()), pa.array(scores, pa.float64())], [id_col, "n_symbols", "n_phrases", "n_own_phrases", "score"])

    first = answered(table.mapInArrow(pairs, asked), "pairs")
    second = answered(table.groupBy("batch").cogroup(first.groupBy("batch")).applyInArrow(longer, asked), "factors")
    left = saved(table.groupBy("batch").cogroup(first.union(second).groupBy("batch")).applyInArrow(started, kept), "starts")
    freed(spark)
    for done in (table, first, second):
        dropped(done)
    while left.agg(F.sum("stretches")).first()[0]:
        got = answered(left.where("stretches > 0").mapInArrow(asking, asked), "factors")
        before, left = left, saved(left.groupBy("batch").cogroup(got.groupBy("batch")).applyInArrow(narrowed, kept), "starts")
        freed(spark)
        for done in (before, got):
            dropped(done)
    return left.mapInArrow(rated, f"{id_col} {kind}, n_symbols bigint, n_phrases bigint, n_own_phrases bigint, score double")
