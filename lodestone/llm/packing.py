"""Packing of token pieces into fixed windows (operator 10): best-fit decreasing.

Overlong documents are first cut into full windows. What remains is packed longest first; a segment tree indexed by
remaining capacity finds the open window that each piece fits most tightly. How pieces fall into windows depends on their
lengths alone, so the plan is made from the counts of each length, a row for each length up to the window: windows
with the same contents so far are one entry of the tree and take their next pieces together. The plan covers the whole
table, has at most a few rows for each length, and is the same however the table is partitioned. Each piece finds its
place in the plan by its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import codec, tokenizer_path
from .common import saved, ship, small_batches, take, texts_of

END_ID = 2


class OpenWindows:
    """Segment tree over remaining capacities 0..window; a leaf counts the kinds of open windows with that much room."""

    def __init__(self, window: int):
        self.size = 1
        while self.size <= window:
            self.size *= 2
        self.tree = [0] * (2 * self.size)
        self.at: list[list] = [[] for _ in range(window + 1)]

    def _add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.tree[i] += n
            i >>= 1

    def put(self, room: int, entry: tuple) -> None:
        self.at[room].append(entry)
        self._add(room, 1)

    def tightest(self, need: int) -> tuple[int, tuple] | None:
        """Take an entry with the least room of at least ``need``: (room, entry)."""
        tree, i = self.tree, need + self.size
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i *= 2
                if not tree[i]:
                    i += 1
        room = i - self.size
        self._add(room, -1)
        return room, self.at[room].pop()


def plan(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing for so many pieces of each length: rows ``length, base, quantity, first, offset``.

    The pieces of a length from rank ``base`` on fill windows from number ``first`` on, ``quantity`` pieces to each, one after
    another from ``offset`` on, up to the length's next row.
    """
    tree = OpenWindows(window)  # entries: number of windows, their contents as (length, quantity, offset)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            # a window that took a piece and has room for another is still the tightest, so it takes all that it can
            room, (windows, contents) = tree.tightest(length) or (window, (left, ()))
            most = room // length
            filled, rest = min(windows, left // most), 0
            left -= filled * most
            if filled:
                tree.put(room - most * length, (filled, (*contents, (length, most, window - room))))
            if left and filled < windows:
                rest, left = left, 0
                tree.put(room - rest * length, (1, (*contents, (length, rest, window - room))))
            if contents and windows - filled - (rest > 0):
                tree.put(room, (windows - filled - (rest > 0), contents))
    out, first, base = [], 0, Counter()
    for room in range(window + 1):
        for windows, contents in tree.at[room]:
            for length, quantity, offset in contents:
                out.append((length, base[length], quantity, first, offset))
                base[length] += windows * quantity
            first += windows
    return sorted(out)


class Places:
    """Finds a piece's window and offset in a plan."""

    def __init__(self, rows: list[tuple[int, int, int, int, int]]):
        self.table = np.array(rows, np.int64).reshape(-1, 5)
        self.keys = self._key(self.table[:, 0], self.table[:, 1])

    @staticmethod
    def _key(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return length << np.int64(40) | rank

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = self.table[np.searchsorted(self.keys, self._key(length, rank), side="right") - 1]
        nth = rank - row[:, 1]
        return row[:, 3] + nth // row[:, 2], row[:, 4] + nth % row[:, 2] * length


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(window number, offset) of each piece of a list in memory; equal lengths keep their order."""
    seen: dict[int, int] = defaultdict(int)
    ranks = []
    for n in lengths:
        ranks.append(seen[n])
        seen[n] += 1
    at, offset = Places(plan(seen, window))(np.array(lengths, np.int64), np.array(ranks, np.int64))
    return list(zip(at.tolist(), offset.tolist()))


def pieces(docs: DataFrame, window: int, path: str, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """``id, start, length, ids_crc32, doc_tokens`` and, on request, ``ids`` of each piece of each document. No shuffle."""
    d = take(docs, id_col, text_col, into=("id", "text"))
    ship(docs.sparkSession)
    end = END_ID.to_bytes(4, "little")
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in small_batches(whole, "text", 4 << 20):
                rows = []
                for key, ids in zip(part.column(0).to_pylist(), codec(path).encode(texts_of(part))):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        piece = ids[4 * start : 4 * (start + window)]
                        rows.append((key, start, len(piece) // 4, zlib.crc32(piece), n, *[memoryview(piece).cast("I").tolist()] * with_ids))
                types = [part.column(0).type, *[pa.int64()] * 4, *[pa.list_(pa.int64())] * with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    kind = d.schema["id"].dataType.simpleString()
    return d.mapInArrow(run, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<bigint>" * with_ids)


def pack(docs: DataFrame, window: int = 4096, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document's ids (and the end id): ``doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset`` and, on request, ``ids``.

    Null and empty texts are a piece with the end id alone; repeated rows and repeated or null ids are packed each on
    its own; an empty table gives no rows; other columns are not read. Sequences are numbered from 0 without gaps and meant to
    be padded to ``window``; pieces of one length take their places by id, start and checksum, whatever the partitions.
    """
    path = path or tokenizer_path("word_bpe_49k.json")
    cut = pieces(docs, window, path, id_col, text_col, with_ids)
    found = saved(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    ordered = found.orderBy("length", "id", "start", "ids_crc32", "doc_tokens", "row").drop("row").withColumn("at", F.monotonically_increasing_id())
    table = saved(ordered, "ordered")
    # one row for each range of the sort and each length in it; a length's rows are in consecutive ranges
    part = F.shiftright("at", 33)
    counts = saved(table.groupBy("length", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first")), "lengths")
    places = plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, window)  # at most ``window`` rows
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("length", "part", (before - F.col("first")).alias("shift"))
    ranked = table.withColumn("part", part).join(starts, ["length", "part"]).withColumn("rank", F.col("at") + F.col("shift"))
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Places(places)
        for b in batches:
            at = find(*(b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank")))
            own = {"sequence_id": pa.array(at[0]), "offset": pa.array(at[1])}
            yield pa.RecordBatch.from_arrays([own[c] if c in own else b.column(b.schema.get_field_index(c)) for c in names], names)

    kind = table.schema["id"].dataType.simpleString()
    schema = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<bigint>" * with_ids
    return ranked.select(*[c for c in names if c not in ("sequence_id", "offset")], "rank").mapInArrow(placed, schema).withColumnRenamed("id", id_col)
