import glob
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers import DOCS, clashing, edge_rows  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def llm(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    return spark


@pytest.fixture(scope="session")
def edge(llm):
    return clashing(llm.createDataFrame(edge_rows(), DOCS).repartition(3))


@pytest.fixture(scope="session")
def none(llm):
    return llm.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(llm):
    assert glob.glob(f"{SF}/documents.parquet")
    return llm.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}
