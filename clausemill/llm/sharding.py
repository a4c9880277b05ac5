"""Placement of rows on shards through a lookup table filled by turns.

The table has a prime number of slots.  Each shard prefers the slots in an order of its own (a start and a step from
the MD5 of its name); shards take turns, and at its turn a shard claims the first slot it prefers that is still free,
until none is.  Shards own equal shares but for one slot, and when a shard comes or goes few other slots change hands.
A row's key hashes to a slot (60 bits of the MD5 of its string), and the table, which has `slots` rows whatever the
input, is broadcast: placement costs one lookup and no shuffle, so hot keys or sources make no hot task.

Defined cases: a null key is placed as the empty string is; repeated keys share a shard; an empty table gives no rows;
no shards, repeated names, names with a comma, or a number of slots that is not prime or not above that of the shards
are errors; a column of the table named as an output (slot, shard, in any case) gives way to it, also where it is the
key; other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.llm.shared import fresh

SLOTS = 65537


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The number of the shard that owns each slot."""
    if not shards or len(set(shards)) < len(shards) or any("," in x for x in shards):
        raise ValueError("shards need different names without commas")
    if slots <= len(shards) or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots is a prime above the number of shards")
    digests = [hashlib.md5(x.encode()).hexdigest() for x in shards]
    at = [int(x[:15], 16) % slots for x in digests]
    step = [int(x[17:], 16) % (slots - 1) + 1 for x in digests]
    owner, free = [-1] * slots, slots
    while True:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            owner[at[k]] = k
            free -= 1
            if not free:
                return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def lookup_table(docs: DataFrame, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """slot, shard: the filled table, as `slots` rows."""
    owners = ",".join(shards[k] for k in fill(shards, slots))
    return docs.sparkSession.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "shard"))


def place(docs: DataFrame, shards: list[str], key_col: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """The rows with their columns, slot (int) and shard (string)."""
    at, of, owner = (fresh(x, docs.columns) for x in ("at", "of", "owner"))
    rows = docs.withColumn(at, slot_of(F.col(f"`{key_col}`"), slots))
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("slot", "shard")]
    placed = rows.join(F.broadcast(lookup_table(docs, shards, slots).toDF(of, owner)), F.col(at) == F.col(of))
    return placed.select(*own, F.col(at).alias("slot"), F.col(owner).alias("shard"))
