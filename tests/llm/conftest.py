import pytest


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from surveykit.session import ship_code
    ship_code(spark)


@pytest.fixture(scope="session")
def docs_of(spark):
    """(doc_id, text[, source]) rows as a table with extra columns of awkward names."""
    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s") for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, source string")
        if extra:
            df = df.selectExpr("*", "doc_id as id", "text as key", "1 as n", "2 as shard", "3 as slot", "4 as `a.b`",
                               "5 as node", "6 as __place", "7 as comp", "8 as block", "9 as size")
        return df
    return make
