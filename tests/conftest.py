import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    made = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made


@pytest.fixture
def one(spark):
    """The value of a column over literal values."""
    from pyspark.sql import functions as F

    return lambda column, **values: spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]
