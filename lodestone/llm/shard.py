"""Sharding (operator 4, native): jump consistent hashing.

Each key drives a linear congruential generator; the bucket jumps ahead by the published rule until it would pass the
last shard. The shard depends on the key and the number of shards alone, and one more shard takes rows only into
itself. Everything is DataFrame functions: 64-bit products are taken in 16-bit limbs so that no mode of arithmetic sees
an overflow. Slots come from one global sort (sampled ranges, ties broken by the row's own place, so no hot key gathers
in one task) and a table of row counts for each range and shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved, take, unsigned_crc32

MULTIPLIER = 2862933555777941757
MASK = 0xFFFF


def _step(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2^64."""
    k = [F.shiftrightunsigned(key, 16 * i).bitwiseAND(F.lit(MASK)) for i in range(4)]
    m = [MULTIPLIER >> 16 * i & MASK for i in range(4)]
    out, carry = [], F.lit(1)
    for i in range(4):
        total = carry
        for j in range(i + 1):
            total = total + k[j] * F.lit(m[i - j])
        out.append(total.bitwiseAND(F.lit(MASK)))
        carry = F.shiftrightunsigned(total, 16)
    return out[0].bitwiseOR(F.shiftleft(out[1], 16)).bitwiseOR(F.shiftleft(out[2], 32)).bitwiseOR(F.shiftleft(out[3], 48))


def _jump(b: Column, key: Column) -> Column:
    """The next bucket: floor((b + 1) * 2^31 / (key / 2^33 + 1))."""
    top = (F.shiftrightunsigned(key, 33) + 1).cast("double")
    return F.floor((b + 1).cast("double") * (F.lit(2147483648.0) / top)).cast("long")


def jumps(key: Column, shards: int) -> Column:
    """The last bucket below ``shards`` that a long key jumps to (``b``) and the next (``j``). Each jump moves ahead by one at
    least, so ``shards`` jumps suffice. ``b`` is the key's shard; with one more shard it is ``shards`` if that is the next jump."""
    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), key.cast("long").alias("k"))

    def jump(s: Column, _: Column) -> Column:
        k = _step(s["k"])
        moved = F.struct(s["j"].alias("b"), _jump(s["j"], k).alias("j"), k.alias("k"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, jump)


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a long key, 0 to ``shards - 1``."""
    return jumps(key, shards)["b"]


def key_of(df: DataFrame, id_col: str) -> Column:
    """A whole number is its own key, null is -1; an id of another type is hashed."""
    if df.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(F.col(id_col).cast("long"), F.lit(-1).cast("long"))
    return F.when(F.col(id_col).isNull(), F.lit(-1).cast("long")).otherwise(F.xxhash64(F.col(id_col).cast("string")))


def assign(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row of ``docs``; the law is ``key``.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 16; ``slot`` counts from 0 within the shard by id, then
    checksum, then size; ``grown_shard`` is the shard with one more. A null id is hashed as -1, and an id that is no whole number by its text; repeated ids share a
    shard; repeated rows get a slot each; an empty table gives no rows; other columns are not read.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    text = F.col("_text")
    d = take(docs, id_col, text_col, into=(id_col, "_text")).select(id_col, F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("b"), unsigned_crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("_row"))
    grown = F.when(F.col("_s.j") == shards, F.lit(shards)).otherwise(F.col("_s.b"))
    rows = d.select("*", jumps(key_of(d, id_col), shards).alias("_s")).select(id_col, (F.col("b") + 16).alias("size"), "text_crc32", F.col("_s.b").cast("int").alias("shard"), grown.cast("int").alias("grown_shard"), "_row")
    ordered = rows.orderBy("shard", id_col, "text_crc32", "size", "_row").drop("_row").withColumn("at", F.monotonically_increasing_id())
    table = saved(ordered, "sharded")
    # one row for each range of the sort and each shard in it: the ranges are as many as the sort's partitions
    part = F.shiftright("at", 33)
    counts = table.groupBy("shard", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "part", (before - F.col("first")).alias("shift"))
    placed = table.withColumn("part", part).join(starts, ["shard", "part"])
    return placed.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("at") + F.col("shift")).alias("slot"), "grown_shard")
