from __future__ import annotations

import __spark_entry__ as entry


def test_names_and_oracles_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
