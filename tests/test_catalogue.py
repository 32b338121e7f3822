"""Every query with SQL gives the rows that DuckDB gives for it."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from lodemine.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, duck, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = duck.sql(catalogue.ORACLES[name])
    assert got == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_refit_keeps_all_negatives(spark, sf):
    first = {r.cluster_id: r.n_neg for r in catalogue.QUERIES["svm_fit"](spark, sf).collect()}
    again = {r.cluster_id: r.n_neg for r in catalogue.QUERIES["hard_negative_round"](spark, sf).collect()}
    assert again.keys() == first.keys() and all(again[c] >= n for c, n in first.items())


def test_image_queries_take_every_image_and_patch(spark, sf, monkeypatch):
    of = catalogue.images
    monkeypatch.setattr(catalogue, "images", lambda *a: of(*a).filter("imidx IN (5, 55)"))
    run = lambda name: catalogue.QUERIES[name](spark, sf)
    patches = run("weighted_patches").toPandas()
    assert set(patches.width) == {8 * 8 * 33} and patches.groupby("imidx").size().min() > 2
    assert run("patch_crops").count() == len(patches)
    assert run("nearest_windows").select("patch_id").distinct().count() == (patches.imidx == 5).sum()
    assert {r.detector for r in run("detect_in_images").select("detector").distinct().collect()} == {5, 55}
