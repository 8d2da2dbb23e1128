"""Sharding by a permutation-filled lookup table, with DataFrame and SQL functions only.

The table has a prime number of slots.  Shards take turns; in its turn a shard claims the next free slot
in its own preference order, the arithmetic progression `offset + k * skip` modulo the prime.  Every
shard so gets the same number of slots, give or take one, and when a shard is added or taken away few
slots change hands.  The table has one row a slot whatever the data's size, so it is broadcast, and a
row's shard is one hash and one look-up; rows are never exchanged.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _number(text: str) -> int:
    """The first 60 bits of the MD5 digest."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(shards: list[str], slots: int) -> list[int]:
    """The shard (its position in `shards`) that each slot belongs to.

    Work and memory follow the number of slots.  Raises ValueError when `slots` isn't prime or there are
    no shards, fewer slots than shards, or shards of the same name.
    """
    if not is_prime(slots):
        raise ValueError(f"the number of slots must be prime: {slots}")
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("there must be at least one shard, no two of one name, and a slot for each")
    at = [_number(f"{s}:offset") % slots for s in shards]
    skip = [_number(f"{s}:skip") % (slots - 1) + 1 for s in shards]
    owner, left = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            owner[at[i]] = i
            left -= 1
            if not left:
                return owner


def lookup_table(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """The filled table as rows (slot int, shard string), made from a literal."""
    owner = F.lit(" ".join(map(str, fill(shards, slots))))
    names = F.array(*[F.lit(s) for s in shards])
    rows = spark.range(1).select(F.posexplode(F.split(owner, " ")).alias("slot", "n"))
    return rows.select("slot", F.element_at(names, F.col("n").cast("int") + 1).alias("shard"))


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key: the first 60 bits of the MD5 digest of its text, modulo the number of slots."""
    head = F.substring(F.md5(key.cast("string").cast("binary")), 1, 15)
    return (F.conv(head, 16, 10).cast("long") % F.lit(slots)).cast("int")


def assign_shards(rows: DataFrame, key: str, shards: list[str], slots: int = 65537) -> DataFrame:
    """Add `slot` int and `shard` string to every row; no row moves.

    Equal keys get the same shard wherever they stand.  A null key takes the place of the empty text.
    Columns of `rows` that are called slot or shard are replaced.  An empty table stays empty.
    """
    if key in ("slot", "shard"):
        raise ValueError("the key must not be called slot or shard")
    table = lookup_table(rows.sparkSession, shards, slots)
    kept = rows.drop("slot", "shard")
    at = slot_of(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), slots)
    return kept.join(F.broadcast(table), at == F.col("slot"), "left")


def weights_of(shards: DataFrame) -> DataFrame:
    """Rows by shard, to see how even an assignment is."""
    return shards.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"))
