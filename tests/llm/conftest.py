import pytest
from messy_rows import CLASHING, ROWS


@pytest.fixture(scope="session")
def messy(spark):
    """The rows above with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.select("*", F.lit("en").alias("lang"), *[F.lit(f"mine_{c}").alias(c) for c in CLASHING]).repartition(3)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)
