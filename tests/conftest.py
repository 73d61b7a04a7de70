import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def registry(spark):
    from astroloom.registry import Registry

    r = Registry(spark)
    stars = [(1, 10.0, 20.0, 5.0, "a"), (2, 100.0, -5.0, 8.0, "b"), (3, 0.5, 89.9, 12.0, "c"), (4, 359.5, 0.2, None, "a%")]
    r.add_frame(
        "cats.stars",
        spark.createDataFrame(stars, "id long, ra double, dec double, mag float, name string"),
        ra_column="ra",
        dec_column="dec",
    )
    r.add_frame(
        "cats.galaxies",
        spark.createDataFrame([(1, 10.0, 20.0, 0.1), (9, 359.9, 0.3, 0.2)], "galaxy_id long, ra double, dec double, redshift double"),
    )
    regions = [
        (1, 0.0, 0.0, "POLYGON ICRS 359 -1 1 -1 1 1 359 1"),
        (2, 10.0, 20.0, "POLYGON ICRS 9 19 11 19 11 21 9 21"),
        (3, 1.0, 1.0, "bad"),
        (4, 1.0, 1.0, None),
    ]
    r.add_frame("cats.footprints", spark.createDataFrame(regions, "id long, ra double, dec double, s_region string"))
    r.publish_schema()
    return r


@pytest.fixture
def engine(spark, registry):
    from astroloom.engine import Engine

    return Engine(spark, registry)
