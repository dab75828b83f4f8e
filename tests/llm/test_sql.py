"""Queries of the training-data operators that SQL can express, held against their SQL."""

from __future__ import annotations

import pytest
from conftest import plain
from heliograph.llm import queries as Q


def rows(table) -> list[tuple]:
    names = sorted(table.column_names)
    fixed = lambda v: tuple(v) if isinstance(v, list) else plain(v)
    return sorted((tuple(fixed(r[c]) for c in names) for r in table.to_pylist()), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", list(Q.ORACLE_SQL))
def test_query(name, spark, sf, duck):
    got, want = Q.QUERIES[name](spark, sf).toArrow(), duck.execute(Q.ORACLE_SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


def test_sql_of_odd_texts(spark, tmp_path):
    """The same over texts that the given tables don't have."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    texts = ["", None, " ", "a  b\n\n c\t\td ", "don't I'LL 12345678 日本語 🎈", "word " * 300, "é" * 60 + " x", "\x01 x\n\n  y \x0b z", "tail  "]
    docs = pa.table({"doc_id": pa.array([*range(len(texts)), None, 5]), "text": [*texts, "word " * 300, "word " * 300]})
    bench = pa.table({"item_id": [1, 2, None], "text": ["word " * 9, "a B c d don't i'll 12345678 日本語", None]})
    for name, rows_ in (("documents", docs), ("benchmark", bench)):
        pq.write_table(rows_, tmp_path / f"{name}.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet')")
    for name, sql in Q.ORACLE_SQL.items():
        if name != "op2_sharding":
            assert rows(Q.QUERIES[name](spark, str(tmp_path)).toArrow()) == rows(con.execute(sql).to_arrow_table()), name
