"""Versions of tables that change together."""

from __future__ import annotations

import shutil

import pytest
from conftest import sale
from pyspark.sql import functions as F

from ripecast.sources import snapshots


def seen(tables):
    return {n: sorted(map(tuple, df.collect())) for n, df in tables.items()}


@pytest.fixture
def pair(make_sales, make_inventory):
    def make(n):
        return {"sales": make_sales([sale("2024-01-01", f"P{i}", quantity=n) for i in range(n)]),
                "inventory": make_inventory([("2024-01-02", f"P{i}", 10 * n, 7) for i in range(n)])}
    return make


@pytest.mark.parametrize("fmt", snapshots.FORMATS)
def test_versions(spark, pair, tmp_path, fmt):
    root = str(tmp_path / "data")
    assert snapshots.versions(spark, root) == []
    with pytest.raises(ValueError, match="no finished version"):
        snapshots.read(spark, root)
    assert [snapshots.write(pair(n), root, fmt) for n in (2, 3)] == [1, 2]
    assert snapshots.versions(spark, root) == [1, 2]
    assert seen(snapshots.read(spark, root, verify=True)) == seen(pair(3))
    assert seen(snapshots.read(spark, root, 1)) == seen(pair(2))
    assert {n: df.schema.simpleString() for n, df in snapshots.read(spark, root).items()} == {
        n: df.schema.simpleString() for n, df in pair(1).items()}
    with pytest.raises(ValueError, match="no finished version 7"):
        snapshots.read(spark, root, 7)


def test_a_failure_between_the_tables_leaves_the_old_pair(spark, pair, tmp_path):
    root = str(tmp_path / "data")
    snapshots.write(pair(2), root)
    broken = pair(5)
    broken["inventory"] = broken["inventory"].withColumn("current_stock", F.raise_error(F.lit("disk full")).cast("bigint"))
    with pytest.raises(Exception, match="disk full"):
        snapshots.write(broken, root)
    assert (tmp_path / "data" / "tables").exists() and len(list((tmp_path / "data" / "tables").iterdir())) == 2
    assert seen(snapshots.read(spark, root, verify=True)) == seen(pair(2))
    assert snapshots.write(pair(4), root) == 2
    assert seen(snapshots.read(spark, root)) == seen(pair(4))


def test_an_unfinished_manifest_does_not_count(spark, pair, tmp_path):
    root = str(tmp_path / "data")
    for n in (2, 3):
        snapshots.write(pair(n), root)
    (tmp_path / "data" / "manifests" / "2" / "_SUCCESS").unlink()
    assert snapshots.versions(spark, root) == [1]
    assert seen(snapshots.read(spark, root)) == seen(pair(2))
    assert snapshots.write(pair(4), root) == 3


def test_of_two_writers_one_wins(spark, pair, tmp_path, monkeypatch):
    root = str(tmp_path / "data")
    snapshots.write(pair(2), root)
    monkeypatch.setattr(snapshots, "_taken", lambda *_: 0)
    with pytest.raises(Exception, match="(?i)already.exists"):
        snapshots.write(pair(3), root)
    assert seen(snapshots.read(spark, root)) == seen(pair(2))


def test_lost_rows_are_noticed(spark, pair, tmp_path):
    root = str(tmp_path / "data")
    snapshots.write(pair(3), root)
    shutil.copytree(next((tmp_path / "data" / "tables").iterdir()) / "sales", tmp_path / "kept")
    for part in (tmp_path / "data" / "tables").glob("*/sales/part-*"):
        part.unlink()
    snapshots.read(spark, root)
    with pytest.raises(ValueError, match="3 were written"):
        snapshots.read(spark, root, verify=True)


def test_empty_tables_and_wrong_use(spark, pair, tmp_path):
    root = str(tmp_path / "data")
    snapshots.write({n: df.limit(0) for n, df in pair(2).items()}, root)
    assert seen(snapshots.read(spark, root, verify=True)) == {"sales": [], "inventory": []}
    with pytest.raises(ValueError, match="unsupported format"):
        snapshots.write(pair(1), root, "xls")
    with pytest.raises(ValueError, match="at least one table"):
        snapshots.write({}, root)
