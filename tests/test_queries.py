"""A part of the registered queries against their SQL; tools/compare.py runs them all."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, rows_of

SOME = [
    "C1_objects", "C2_object_relations", "E1_image_caps", "B11_drop_reasons", "E10_bucket_quota", "E8_group_split", "D11_metrics_strict", "D14_flips", "D20_best_threshold",
    "D33_sweep_tags", "G5_head_scores", "G13_condition_balanced", "G24_alignment", "F4_image_overlap", "F5_head_ownership", "H6_question_parts", "H8_router_weights", "P6_record_rows",
    "A2_json_documents", "A8_run_folders", "A13_ordered_fingerprint", "I2_live_counters",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query_agrees_with_sql(spark, sf_dir, con, name):
    df = entry.queries()[name](spark, sf_dir)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cur.fetchall())


def test_contract():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and entry.FLAGSHIP in names
