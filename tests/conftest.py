import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from semisketch.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        "4",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def docs(spark):
    """Documents of texts: docs({'id': '{"a": 1}'})."""
    from semisketch.sources.documents import parse_documents, valid_docs

    def build(texts):
        rows = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
        return valid_docs(parse_documents(rows))

    return build
