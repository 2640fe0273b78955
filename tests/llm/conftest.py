import os

import pytest
from odd_rows import TEXTS
from pyspark.sql import types as T

# this module may be the one that a test beside tests/conftest.py finds under the name conftest
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()),
                       # names that the results use too
                       T.StructField("h", T.LongType()), T.StructField("n_tokens", T.StringType()),
                       T.StructField("score", T.StringType()), T.StructField("root", T.StringType())])

@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, copies, repeated rows and ids, and extra
    columns whose names clash with the results'."""
    rows = [(i, t, "en", None, None if t is None else len(t), 7, "x", "y", None) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    """Labels with nulls and contradictions; most of the odd documents have none."""
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1), (6, None, None), (99, 1, 1)],
                                 "doc_id long, quality int, toxic int")
