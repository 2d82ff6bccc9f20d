import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from llm_cases import ODD  # noqa: E402

@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use inside."""
    df = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
    clash = ("key", "row", "part", "n", "digest", "bands", "node", "h", "shard", "length", "start", "severity", "spans", "items", "digest_key")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)])


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
