import uuid

import pytest
from edge_rows import EDGES


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory):
    """Write rows as a table with columns whose names clash with the operators' own, and read it."""

    def put(rows, schema="doc_id long, text string", parts=3, clash=True):
        df = spark.createDataFrame(rows, schema)
        if clash:
            df = df.selectExpr("*", "'en' as lang", "cast(length(text) as bigint) as n_chars", *[f"'?' as {c}" for c in ("uid", "id", "i", "h", "name", "block", "bucket", "size", "kind", "start", "score", "rank", "doc", "source")])
        folder = str(tmp_path_factory.mktemp("t") / uuid.uuid4().hex)
        df.repartition(parts).write.parquet(folder)
        return spark.read.parquet(folder)

    return put


@pytest.fixture(scope="session")
def edges(stored):
    return stored(EDGES)


@pytest.fixture(scope="session")
def empty(stored):
    return stored([], parts=1)
