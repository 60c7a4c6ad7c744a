"""Queries with SQL against it, on the small tables and on odd and empty ones."""

from __future__ import annotations

import oracle
import pyarrow.parquet as pq
import pytest

from featuregrid.llm import entries


@pytest.mark.parametrize("name", sorted(entries.ORACLES))
def test_small_tables(spark, data, name):
    oracle.same_rows(entries.QUERIES[name](spark, data), entries.ORACLES[name], data)


def odd_tables(spark):
    bench = spark.createDataFrame([(1, "quick BROWN fox, jumps over the lazy dog near the river bank"), (10, "one"), (2, None), (3, ""), (4, "word0 and0 word1 and1 word2 and2 word3 and3 word4 and4 word5 and5 word6 and6"), (None, "lazy dog near"), (5, "ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab")], "item_id long, text string")
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", None), (1, 1, "assistant", ""), (1, 2, "user", "more"), (2, None, None, "x"), (3, 0, "user", "hi"), (3, 0, "user", "hi"), (4, 0, "user", "hi"), (4, 1, "assistant", "a"), (4, 2, "assistant", "a"), (5, 0, "user", "hi"), (5, 1, "assistant", "a"), (7, 0, "assistant", "z")]
    return {"benchmark": bench, "conversations": spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")}


@pytest.mark.parametrize("name", sorted(entries.ORACLES))
@pytest.mark.parametrize("empty", [False, True])
def test_odd_and_empty_tables(spark, odd, none, tmp_path, monkeypatch, name, empty):
    repeated = spark.createDataFrame([(20, "ab " * 50), (21, "ab " * 12)], "doc_id long, text string")
    docs = none if empty else odd.unionByName(repeated, allowMissingColumns=True)
    tables = {"documents": docs.select("doc_id", "text", "lang", "source", "n_chars"), **{k: df.where("1 = 0") if empty else df for k, df in odd_tables(spark).items()}}
    for table, df in tables.items():
        pq.write_table(df.toArrow(), tmp_path / f"{table}.parquet")
    monkeypatch.setattr(oracle, "TABLES", list(tables))
    oracle.same_rows(entries.QUERIES[name](spark, str(tmp_path)), entries.ORACLES[name], str(tmp_path))
