"""Shards by jump consistent hashing: a stable key and the number of shards decide, and no ring table is kept.

The walk of Lamping and Veach (2014): a linear congruential sequence seeded with the key gives the shard numbers at
which the key would jump; the last jump below the number of shards is its shard. Appending a shard moves only the keys
whose next jump lands on it. Only column expressions; unsigned 64-bit products are held in decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from treeweave.operators.ordering import numbered

# Fixed values of the published method.
MULTIPLIER = 2862933555777941757
WORD = 1 << 64

SHARDS = 40
# Jumps grow like the logarithm of the number of shards; a key that needs more walks on in a second, rarely entered loop.
USUAL_JUMPS = 24
ROW_BYTES = 16


def stable_key(key: Column) -> Column:
    """A key of any type as an unsigned 64-bit number, the leading digits of the digest of its text; null is a key too."""
    digest = F.md5(F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null")))
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def jump(key: Column, shards: int) -> Column:
    """Struct (`shard`, `next`): the shard of `key` among `shards`, and the shard number at which it would jump next."""
    start = F.struct(
        F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"), key.cast("decimal(20,0)").alias("state")
    )

    def step(walk: Column, _: Column) -> Column:
        state = ((walk["state"] * F.lit(MULTIPLIER).cast("decimal(19,0)") + F.lit(1)) % F.lit(str(WORD)).cast("decimal(20,0)")).cast("decimal(20,0)")
        # The top 31 bits of the state pick the length of the jump.
        top = F.floor(state / F.lit(1 << 33).cast("decimal(20,0)")).cast("double")
        onward = F.floor((walk["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (top + F.lit(1.0))))
        moved = F.struct(walk["next"].alias("shard"), onward.cast("long").alias("next"), state.alias("state"))
        return F.when(walk["next"] < shards, moved).otherwise(walk)

    usual = min(shards, USUAL_JUMPS)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(usual)), start, step)
    if shards > usual:
        further = F.aggregate(F.sequence(F.lit(1), F.lit(shards - usual)), walk, step)
        walk = F.when(walk["next"] < shards, further).otherwise(walk)
    return walk


def with_shard(docs: DataFrame, shards: int = SHARDS, key_col: str = "doc_id", shard: str = "shard", grown: str | None = None) -> DataFrame:
    """`docs` with the column `shard` (0 to `shards` - 1) and, if named, `grown`: the shard among one more.

    Any row counts, also with a null key (all such rows share a shard) or a null text; equal keys share a shard.
    Columns of `docs` that have the names of the new ones are replaced.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    walk = jump(stable_key(F.col(key_col)), shards)
    new = {shard: walk["shard"].cast("int")}
    if grown:
        new[grown] = F.when(walk["next"] == shards, F.lit(shards)).otherwise(walk["shard"]).cast("int")
    return docs.withColumns(new)


def shard_index(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The index of a sharded table: `doc_id`, `size` (bytes of the text and a fixed part), `text_crc32`, `law`, `shard`,
    `slot` (place in its shard, from 0 without gaps, by id) and `grown_shard` (the shard once one more is appended).

    A null text has no bytes and no checksum. Slots are numbered in range-partitioned slices, so a large shard is no
    single task. Equal rows take neighbouring slots. Other columns are not read. An empty table gives no rows.
    """
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.col(text_col).cast("binary")).alias("text_crc32"),
    )
    placed = with_shard(narrow, shards, "doc_id", "shard", "grown_shard")
    order = [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32").asc_nulls_first()]
    return numbered(placed, ["shard"], order, "slot").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("slot") - 1).cast("long").alias("slot"), "grown_shard",
    )
