import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_rows import SCHEMA, rows  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    data = [(i, t, lang, "src0", len(t or ""), 0.5, 3, 9, 9, "x") for i, t, lang in rows()]
    path = str(tmp_path_factory.mktemp("odd") / "documents")
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
