import duckdb
import pytest
from pyspark.sql import functions as F

#: Rows that every operator on documents has to stand: nulls, empty and blank texts, repeats, characters beyond ASCII, a long text.
ODD = [
    (1, "a b c d e f g", "en", "s1", 13), (2, None, None, None, None), (3, "", "en", "s1", 0), (4, " \t\n ", "en", None, 4), (5, "a b c d e f g", "en", "s2", 13),
    (5, "a b c d e f g", "en", "s2", 13), (None, "x y", "en", "s2", 3), (6, "Ünïcödé 漢字 😀 mail me@example.org", "de", "s3", 30), (7, "one", "en", "s3", 3),
    (8, "word " * 30000, "en", "s3", 150000), (9, "A B C D E F G", "en", "s1", 13), (10, "x" * 5000, "en", "s3", 5000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"label": F.lit(1), "words": F.lit("clash"), "key": F.lit(0), "size": F.lit(9), "u": F.lit(1)})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts(sf_dir):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
