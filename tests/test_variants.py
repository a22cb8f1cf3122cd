"""Run-length masks against pixels, overlaps of prefixes against sets, and the further modes against their SQL."""

import random
from collections import defaultdict

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, rows_of
from pairloom.operators import facts, sets

MODES = ["A3_segments", "A10_padded_names", "B7_metadata_bucket", "B13_bad_bank", "C12_run_colors", "D25_f1_matrix", "D33_direction_verdict", "G12_bucket_directions", "G22_overlaps", "G23_composed", "E3_seeded_selection", "E8_penalty_balance", "G9_frozen_test"]


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", MODES)
def test_mode_agrees_with_sql(spark, sf_dir, con, name):
    df = entry.queries()[name](spark, sf_dir)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cur.fetchall())


@pytest.mark.parametrize("size", [1, 7, 64, 4096])
def test_colors_of_runs_are_those_of_their_pixels(spark, size):
    rng = random.Random(size)
    pixels = [(i, p, *(rng.randrange(256) for _ in range(3))) for i, n in (("a", 150), ("b", 64), ("c", 1), ("d", 20)) for p in range(n)]
    segments, mask = {}, []
    for i, p, *_ in pixels:
        segments[i, p] = segments.get((i, p - 1), 1) if rng.random() < 0.8 else rng.randrange(4)
        if i != "d" or p != 5:  # a mask that is smaller than its raster
            mask.append((i, p, segments[i, p]))
    raster = spark.createDataFrame(pixels, "image_id string, pos long, r int, g int, b int")
    runs = facts.mask_runs(spark.createDataFrame(mask, "image_id string, pos long, segment_id int"))
    assert sum(r["n"] for r in runs.collect()) == len(mask)
    got = {(r["image_id"], r["segment_id"]): r for r in facts.run_colors(facts.raster_blocks(raster, size), runs, size).collect()}
    want = defaultdict(list)
    for i, p, *rgb in pixels:
        if i != "d":
            want[i, segments[i, p]].append(rgb)
    assert set(got) == set(want)
    for k, px in want.items():
        assert got[k]["pixels"] == len(px)
        assert [got[k][c] for c in "rgb"] == pytest.approx([sum(x[j] for x in px) / len(px) for j in range(3)])


def test_overlaps_of_prefixes(spark):
    ranked = [(n, i, r) for n, items in {"x": "abcd", "y": "bzaq", "w": "mnop"}.items() for r, i in enumerate(items, 1)]
    df = spark.createDataFrame([("g", *r) for r in ranked], "g string, name string, item string, rank long")
    got = {(r["a"], r["b"], r["k"]): (r["shared"], r["jaccard"]) for r in sets.prefix_overlaps(df, ["g"], "name", ["item"], (1, 2, 4)).collect()}
    for a, b in (("x", "y"), ("w", "x"), ("w", "y")):
        for k in (1, 2, 4):
            s, t = ({i for n, i, r in ranked if n == name and r <= k} for name in (a, b))
            assert got[a, b, k] == (len(s & t), pytest.approx(len(s & t) / len(s | t)))
