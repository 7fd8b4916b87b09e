import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """The value of a column expression over one row."""

    def evaluate(column, **row):
        from pyspark.sql import functions as F

        frame = spark.range(1)
        for name, item in row.items():
            frame = frame.withColumn(name, item if not isinstance(item, (int, float, str, bool)) else F.lit(item))
        return frame.select(column.alias("x")).first().x

    return evaluate


@pytest.fixture
def frames(spark):
    """Frames of one video from a text of time:score pairs."""

    def make(text: str, duration_ms: int = 60_000, video_id: int = 1):
        rows = [(video_id, k, int(t), float(s), duration_ms) for k, (t, s) in enumerate(x.split(":") for x in text.split())]
        return spark.createDataFrame(rows, "video_id long, arrival long, ts_ms long, score double, duration_ms long")

    return make
