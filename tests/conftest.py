import collections
import math
import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{ROOT / 'tests'}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def canonical(rows):
    """Rows as a counter of tuples, whatever their order; columns by name."""

    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        if isinstance(x, float):
            return round(x, 6)
        return tuple(map(value, x)) if isinstance(x, (list, tuple)) else x

    return collections.Counter(tuple((k, value(v)) for k, v in sorted(r.items())) for r in rows)


def dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]
