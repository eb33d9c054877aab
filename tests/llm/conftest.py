import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_frame(spark):
    def make(*rows, more=""):
        """Documents from (doc_id, text) pairs; ``more`` adds null columns with clashing names."""
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
        for name in more.split():
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit(None).cast("string"))
        return df

    return make
