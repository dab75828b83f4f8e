from __future__ import annotations

from collections import Counter

import pytest
from conftest import rows_of
from heliograph.llm import sharding as S
from heliograph.llm.common import table


def test_against_sql(spark, sf, duck):
    assert rows_of(S.query(spark, sf).toPandas()) == rows_of(duck.execute(S.ORACLE_SQL).df())


def test_table_is_balanced_and_moves_little():
    names = [f"s{i}" for i in range(20)]
    size = S.prime_from(2000)
    full = S.lookup_table(names, size)
    n = Counter(full)
    assert max(n.values()) - min(n.values()) <= 1 and set(n) == set(range(20))
    fewer = S.lookup_table(names[:-1], size)
    moved = sum(a != b for a, b in zip(full, fewer, strict=True) if a != 19)
    assert moved < 0.15 * size
    with pytest.raises(ValueError):
        S.lookup_table(["a", "a"])
    with pytest.raises(ValueError):
        S.lookup_table(["a", "b"], 8)


def test_keys_and_columns(spark):
    rows = [(1, "a", 9), (1, "b", 9), (None, "c", 9), (2, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, shard string, slot int")
    got = S.assign_shards(df).collect()
    assert len(got) == 4 and got[0].asDict().keys() == {"doc_id", "slot", "shard"}
    assert len({(r.slot, r.shard) for r in got if r.doc_id == 1}) == 1
    assert all(r.shard.startswith("shard-") for r in got)
    assert S.assign_shards(df, key="shard").count() == 4
    assert S.assign_shards(df.limit(0)).count() == 0
    assert S.assign_shards(df, shards=["only"]).select("shard").distinct().collect()[0][0] == "only"


def test_long_keys_and_bounds(spark):
    long = "k" * 1_000_000
    df = spark.createDataFrame([(long,), (long,), (long + "x",), ("",), (None,)], "doc_id string")
    got = S.assign_shards(df).collect()
    assert len(got) == 5 and len({r.slot for r in got if r.doc_id == long}) == 1
    assert len({r.slot for r in got if not r.doc_id}) == 1, "a null key counts as the empty text"
    with pytest.raises(ValueError, match="slots"):
        S.lookup_table(["a"], S.prime_from(S.MOST_SLOTS + 1))


def test_written_folders(spark, tmp_path):
    df = spark.range(200).withColumnRenamed("id", "doc_id")
    S.write_sharded(df, str(tmp_path / "out"), shards=["a", "b", "c"])
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and {r.shard for r in back.select("shard").distinct().collect()} == {"a", "b", "c"}
