"""The registered queries on the small tables."""

import corpus_pipeline
import pytest

from checks.compare import connect, difference
from wheeltrace.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, name):
    result = queries.queries()[name](spark, SF_DIR).toPandas()
    if name in queries.oracle_sql():
        sql = queries.oracle_sql()[name]
        assert difference(result, connect(SF_DIR).sql(sql).df()) is None
    else:
        assert len(result) >= 200


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == names
