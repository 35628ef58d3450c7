import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"




@pytest.fixture()
def make_docs(spark):
    """A documents table from texts or (id, text[, source]) rows, with columns whose names might clash."""

    def make(rows, extra=True):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            source = r[2] if len(r) > 2 else "src0"
            full.append((r[0], r[1], "en", source, None if r[1] is None else len(r[1])))
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for name in ("id", "line", "key", "v", "h", "rule", "term", "hits", "component", "_s", "_word", "score", "taken", "digest", "body"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make
