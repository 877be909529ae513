"""SimHash near-duplicates (operator 8) with pivot distance tables.

Fingerprints are 64 bits over 3-word shingles; equal ones are grouped before anything else. For each different
fingerprint a table row holds its Hamming distances to sixteen reference fingerprints. A pair within ``radius`` bits
cannot differ by more than ``radius`` in any coordinate of that table (triangle inequality), so pairs with a larger
coordinate difference are discarded, and what survives is verified by the bits themselves.

The table alone tells pairs apart only once they are paired. So that no more than a small part of all pairs is ever
formed, fingerprints first meet in bands: of five bands of bits, two at least are equal between fingerprints that differ in
at most three bits, so the ten choices of two bands lose no link (25 or 26 equal bits each). A crowded band is cut into tiles of
bounded size that meet pairwise, in many tasks; nothing is capped.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_at, dropped, met_by_key, numbered, over_text, saved, take, texts_of

RADIUS = 3
SEED = 42
PIVOTS = [int(x) for x in np.random.Generator(np.random.PCG64(7)).integers(-(1 << 63), (1 << 63) - 1, 16, dtype=np.int64)]
#: (lowest bit, bits) of the five bands
BANDS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def fingerprint(text: str) -> bytes:
    """Eight bytes, most significant first; a bit is set where over half of the shingles' hashes have it."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space splits
    n = len(words)
    if not n:
        return bytes(8)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if n < 3:
        hashes = digest(joined, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = [0, *(ends[: n - 3]).tolist()]
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[2:] - 1).tolist())])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    count = np.zeros(64, np.int64)
    for k in range(0, len(rows), 8192):
        count += np.unpackbits(rows[k : k + 8192], axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * count > len(rows)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (16 hexadecimal digits) and ``fp`` (the same bits as a long) of each whole text."""
    d = take(docs, id_col, text_col)

    def run(batch: pa.RecordBatch) -> dict:
        got = [fingerprint(t) for t in texts_of(batch, text_col)]
        return {id_col: batch.column(0), "fingerprint": [x.hex() for x in got], "fp": [int.from_bytes(x, "big", signed=True) for x in got]}

    return over_text(d, text_col, f"{id_col} {d.dtypes[0][1]}, fingerprint string, fp bigint", run)


def _band(k: int) -> Column:
    low, bits = BANDS[k]
    return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1))


def _table(fps: DataFrame) -> DataFrame:
    """fp and its sixteen pivot distances, seven bits each, in two longs."""
    distance = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long") for p in PIVOTS]
    packed = []
    for half in (distance[:8], distance[8:]):
        x = half[0]
        for k, d in enumerate(half[1:], 1):
            x = x.bitwiseOR(F.shiftleft(d, 7 * k))
        packed.append(x)
    return fps.select("fp", packed[0].alias("p0"), packed[1].alias("p1"))


def _near_by_pivots(a: str, b: str, radius: int) -> Column:
    near = F.lit(True)
    for half in ("p0", "p1"):
        for k in range(8):
            x, y = (F.shiftright(F.col(f"{side}.{half}"), 7 * k).bitwiseAND(F.lit(127)) for side in (a, b))
            near = near & (F.abs(x - y) <= radius)
    return near


def links(fps: DataFrame, radius: int = RADIUS, tile: int = 2048) -> DataFrame:
    """Pairs ``u < v`` of different fingerprints (column ``fp``, each once) within ``radius`` (3 at most) bits."""
    if not 0 <= radius <= 3:
        raise ValueError("the bands lose no link up to three bits")
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("band"), F.shiftleft(_band(a), 13).bitwiseOR(_band(b)).cast("int").alias("key")) for i, (a, b) in enumerate(combinations(range(5), 2))])
    rows = _table(fps).select("*", F.inline(keys))
    crowded = rows.groupBy("band", "key").count().where(F.col("count") > tile).select("band", "key", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    rows = rows.join(crowded, ["band", "key"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    # tiles i <= j meet at (i, j): as the left side a row goes to (own, j >= own), as the right side to (i <= own, own)
    left = rows.withColumn("other", F.explode(F.sequence("own", F.col("tiles") - 1))).withColumnsRenamed({"own": "i", "other": "j"})
    right = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("own")))).withColumnsRenamed({"other": "i", "own": "j"})
    a, b = left.alias("a"), right.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("band", "key", "i", "j")]
    # within one tile each pair would meet twice
    once = (F.col("a.i") != F.col("a.j")) | (F.col("a.fp") < F.col("b.fp"))
    bits = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp")))
    pairs = a.join(b, same[0] & same[1] & same[2] & same[3] & once & _near_by_pivots("a", "b", radius) & (bits <= radius))
    return pairs.select(F.least("a.fp", "b.fp").alias("u"), F.greatest("a.fp", "b.fp").alias("v")).where("u < v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``v, root``: the smallest node that each linked node reaches (roots included), by alternating large and small stars.

    Every round is two aggregations and joins over the links, written to the shared folder; the rounds end when the
    links no longer change, which one row of sums tells the driver.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        j = both.join(low, "u")
        if large:
            out = j.where("v > u").select(F.col("m").alias("u"), "v")
        else:
            out = j.select(F.col("m").alias("u"), "v").union(low.select(F.col("m").alias("u"), F.col("u").alias("v")))
        return out.where("u < v").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = saved(edges, "links")
    was = state(now)
    while was[0]:
        after = saved(star(star(now, True), False), "stars")
        new = state(after)
        dropped(now)
        now = after
        if new == was:
            break
        was = new
    return now.select("v", F.col("u").alias("root")).union(now.select(F.col("u").alias("v"), F.col("u").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id, root`` of every row of ``docs``.

    ``component_id`` is the smallest id that links of at most ``radius`` bits reach, the own included; null ids take part
    but are never the smallest unless there is no other; ``root`` is the component's smallest fingerprint. Null, empty and
    blank texts have fingerprint zero and are linked like any other; repeated rows give repeated results; an empty table
    gives no rows; other columns are not read.
    """
    rows = saved(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = saved(rows.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")), "different")
    linked = components(links(fps.select("fp"), radius))
    roots = fps.join(linked.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(least, "root").select("fp", "root", "component_id", "n")
    return met_by_key(rows, named, "fp", fps.agg(F.sum("n")).first()[0] or 0).select(id_col, "fingerprint", "component_id", "root")


def one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of ``docs``, with all its columns, for each component: one with the component's smallest id."""
    rows = saved(numbered(docs).withColumn("_row", F.monotonically_increasing_id()), "rows")
    id, text = (F.col(f"_{column_at(docs, c)}") for c in (id_col, text_col))
    names = near_duplicates(rows.select(F.struct(id.isNull().alias("n"), id.alias("id"), F.col("_row").alias("row")).alias("key"), text.alias("text")), "key", "text", radius)
    kept = names.where("key = component_id").select(F.col("key.row").alias("_row"))
    return rows.join(kept, "_row", "left_semi").drop("_row").toDF(*docs.columns)
