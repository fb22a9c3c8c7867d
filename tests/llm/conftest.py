import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, extra=None):
        """texts: strings, or (doc_id, text) pairs. extra: name of one more column, of which all values are 'x'."""
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, None if i is None or i % 5 == 0 else "en", "s", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(rows, DOCS)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumn(extra, F.lit("x"))
        return df

    return make


@pytest.fixture
def words():
    rng = random.Random(5)

    def make(n, vocabulary=2000, seed=None):
        r = random.Random(seed) if seed is not None else rng
        return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))

    return make
