import pytest

CHUNKS = "id string, document_id string, start int, end int, text string"
SOURCES = "id string, municipality_id string, url string, retrieved_at string, media_type string, title string"


@pytest.fixture(scope="session")
def make_chunks(spark):
    def make(rows, extra=False):
        df = spark.createDataFrame(rows, CHUNKS)
        if extra:  # columns that clash with names used inside the operators
            from pyspark.sql import functions as F

            for name in ("line", "item", "cluster", "municipality_id", "pos", "share", "n", "text2", "cls", "span"):
                df = df.withColumn(name, F.lit(None).cast("string"))
        return df

    return make


@pytest.fixture(scope="session")
def make_sources(spark):
    return lambda rows: spark.createDataFrame(rows, SOURCES)


def windows(doc, text, size=2400, overlap=300):
    out, start = [], 0
    while True:
        end = min(start + size, len(text))
        out.append((f"{doc}:{start}:{end}", doc, start, end, text[start:end]))
        if end == len(text):
            return out
        start = end - overlap
