"""Operator 2: sharding by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own, (offset + j * skip)
mod M, which visits each slot once because M is prime.  The shards take turns, each claiming the
first slot of its order that is still free, until the table is full: all shards hold M / N slots to
within one, and removing a shard moves little but its own slots.  A key is hashed to a slot and
the slot gives the shard, so placement is a lookup in a table whose size depends on the number
of shards alone.  The table goes to the executors as a broadcast join (M rows, never with the data);
documents are neither shuffled nor passed through Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import table

N_SHARDS = 64
#: Slots per shard, at least: shard sizes differ by at most one slot in so many.
SLOTS_PER_SHARD = 100
#: Slots that a table may have: a bound of what is broadcast (some 100 MB), enough for 40 000 shards.
MOST_SLOTS = 4_000_000


def prime_from(n: int) -> int:
    """The smallest prime that is at least n."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _digest(text: str) -> int:
    import hashlib

    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], size: int | None = None) -> list[int]:
    """Index of the shard that holds each slot.

    shards: distinct names; order doesn't change their preferences, only who claims first.
    size: prime number of slots; by default the least prime of SLOTS_PER_SHARD times the shards.
    """
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct and at least one")
    m = size or prime_from(SLOTS_PER_SHARD * len(shards))
    if m < len(shards) or prime_from(m) != m:
        raise ValueError("the table size must be a prime that is no less than the number of shards")
    offset = [_digest(f"{s}/offset") % m for s in shards]
    if m > MOST_SLOTS:
        raise ValueError(f"a table of {m} slots is more than {MOST_SLOTS}; give fewer shards, or a size with fewer slots for each")
    skip = [_digest(f"{s}/skip") % (m - 1) + 1 if m > 2 else 1 for s in shards]
    owner, nxt, claimed = [-1] * m, [0] * len(shards), 0
    while True:
        for i in range(len(shards)):
            while owner[slot := (offset[i] + nxt[i] * skip[i]) % m] >= 0:
                nxt[i] += 1
            owner[slot] = i
            nxt[i] += 1
            claimed += 1
            if claimed == m:
                return owner


def slot_of(key: Column, size: int) -> Column:
    """Slot of a key: 60 bits of the MD5 of its text modulo the table size. A null key counts as ''."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(size).cast("long"))


def assign_shards(df: DataFrame, key: str = "doc_id", shards: list[str] | None = None, size: int | None = None) -> DataFrame:
    """df with columns slot (long) and shard (string).

    Columns of these names that df has already are replaced.  Equal keys, and so repeated rows, get
    equal shards; null keys count as the empty text; keys may be of any length (their MD5 counts).  An empty table stays empty.
    """
    names = shards or [f"shard-{i:03d}" for i in range(N_SHARDS)]
    owner = lookup_table(names, size)
    slots = df.sparkSession.createDataFrame([(s, names[i]) for s, i in enumerate(owner)], "slot long, shard string")
    placed = df.withColumn("slot", slot_of(df[key], len(owner))).drop("shard")
    return placed.join(F.broadcast(slots), "slot").select(*[c for c in placed.columns], "shard")


def write_sharded(df: DataFrame, path: str, **how) -> None:
    """Writes df with one folder for each shard; each task writes what it holds, without a shuffle."""
    assign_shards(df, **how).write.partitionBy("shard").mode("overwrite").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


_M = prime_from(SLOTS_PER_SHARD * N_SHARDS)
_HASH = "(('0x' || substr(md5({}), 1, 15))::BIGINT)"
ORACLE_SQL = f"""
WITH RECURSIVE prefs AS (
  SELECT list({_HASH.format("name || '/offset'")} % {_M} ORDER BY i) AS o,
         list({_HASH.format("name || '/skip'")} % ({_M} - 1) + 1 ORDER BY i) AS s
  FROM (SELECT i, 'shard-' || lpad(i::VARCHAR, 3, '0') AS name FROM range({N_SHARDS}) r(i))
), fill AS (
  SELECT 0 AS t, list_transform(range({_M}), lambda x: (-1)::SMALLINT) AS owner, list_transform(range({N_SHARDS}), lambda x: 0::BIGINT) AS nxt
  UNION ALL
  SELECT t + 1, list_transform(owner, lambda x, k: CASE WHEN k = (p.o[i + 1] + j * p.s[i + 1]) % {_M} + 1 THEN i::SMALLINT ELSE x END),
         list_transform(nxt, lambda x, k: CASE WHEN k = i + 1 THEN j + 1 ELSE x END)
  FROM (
    SELECT t, t % {N_SHARDS} AS i, owner, nxt,
           list_filter(range(nxt[t % {N_SHARDS} + 1], {_M}), lambda j: owner[(q.o[t % {N_SHARDS} + 1] + j * q.s[t % {N_SHARDS} + 1]) % {_M} + 1] = -1)[1] AS j
    FROM fill, prefs q WHERE t < {_M}
  ), prefs p
), slots AS (
  SELECT unnest(range({_M})) AS slot, unnest(owner) AS i FROM fill WHERE t = {_M}
), placed AS (
  SELECT *, {_HASH.format("coalesce(doc_id::VARCHAR, '')")} % {_M} AS slot FROM documents
)
SELECT placed.*, 'shard-' || lpad(i::VARCHAR, 3, '0') AS shard FROM placed JOIN slots USING (slot)
"""
