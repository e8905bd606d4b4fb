import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def documents(spark, texts, extra=True):
    """A documents table with clashing extra columns."""
    rows = [(i, t, "k", "t", 7) for i, t in enumerate(texts)]
    names = "doc_id long, text string, k string, t string, n long" if extra else "doc_id long, text string, k2 string, t2 string, n2 long"
    return spark.createDataFrame(rows, names)


@pytest.fixture
def docs():
    return documents
