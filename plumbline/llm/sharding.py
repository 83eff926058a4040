"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size: an offset and a skip, from a hash
of its name, make a permutation. Shards take turns, each claiming the first slot of its order that is still free, until
no slot is. Slots are spread evenly to within one, and when a shard leaves, few rows of the others move. The table has
a fixed size; it is broadcast and a row's place is one hash and one look-up.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import broadcast_checked, fresh_name

SLOTS = 65537
SHARDS = [f"shard-{i:04d}" for i in range(256)]


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """The shard (its place in the list) of each slot."""
    if len(shards) != len(set(shards)) or not shards or len(shards) > slots:
        raise ValueError("shards must be different, at least one, and no more than slots")
    if slots < 2 or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    orders = [(np.int64(_hash("offset:" + s) % slots) + np.arange(slots) * (_hash("skip:" + s) % (slots - 1) + 1)) % slots for s in shards]
    table, nexts, filled = [-1] * slots, [0] * len(shards), 0
    while True:
        for i, order in enumerate(orders):
            at = nexts[i]
            while table[slot := int(order[at])] >= 0:
                at += 1
            table[slot], nexts[i] = i, at + 1
            filled += 1
            if filled == slots:
                return np.array(table, np.int32)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: 60 bits of the MD5 of its text; a null counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint") % F.lit(slots)


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    table = lookup(shards, slots).tolist()
    return spark.createDataFrame([(i, shards[t]) for i, t in enumerate(table)], "slot bigint, shard string")


def shard(df: DataFrame, shards: list[str] | None = None, id_col: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """(id_col, slot, shard) of each row.

    Rows with equal ids share a shard, null ids that of the empty text; repeated rows are kept; no ties arise. Only the
    id is read, so other columns can have any names, and null, empty and very long texts don't matter; an empty table
    gives an empty result.
    """
    names = SHARDS if shards is None else shards
    placed = df.select(F.col(id_col), slot_of(F.col(id_col), slots).alias("slot"))
    return placed.join(broadcast_checked(table_frame(df.sparkSession, names, slots), slots), "slot").select(id_col, "slot", "shard")


def write_shards(df: DataFrame, folder: str, shards: list[str] | None = None, id_col: str = "doc_id", slots: int = SLOTS, rows: int = 1_000_000) -> None:
    """All columns of df, in one folder of Parquet files for each shard (in the column named shard).

    Rows go where shard() says: null ids with those of the empty text, repeated rows all; texts of any length, nulls and
    empty values are written as they are; an empty table writes no shard. A shard of more than about `rows` rows is
    written by several tasks, among which its rows are spread by their contents. A column of df named shard (in any case
    of letters) can't be written beside the folder's own and raises; all other names may be used.
    """
    if "shard" in {c.lower() for c in df.columns}:
        raise ValueError("the table has a column named shard already")
    names = SHARDS if shards is None else shards
    slot, salt = fresh_name(df, "slot_"), fresh_name(df, "salt_")
    keyed = df.withColumn(slot, slot_of(F.col(f"`{id_col}`"), slots))
    table = table_frame(df.sparkSession, names, slots).withColumnRenamed("slot", slot)
    placed = keyed.join(broadcast_checked(table, slots), slot).drop(slot)
    largest = placed.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    parts = -(-largest // rows)
    if parts > 1:
        placed = placed.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(parts))).repartition("shard", salt).drop(salt)
    else:
        placed = placed.repartition("shard")
    placed.write.partitionBy("shard").parquet(folder)


def shard_sql(shards: list[str] | None = None, slots: int = SLOTS) -> str:
    names = SHARDS if shards is None else shards
    table = lookup(names, slots).tolist()
    return (
        f"WITH t AS (SELECT unnest({table}) AS i, generate_subscripts({table}, 1) - 1 AS slot), "
        f"d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {slots} AS slot FROM documents) "
        f"SELECT doc_id, slot::BIGINT AS slot, ({names})[i + 1] AS shard FROM d JOIN t USING (slot)"
    )
