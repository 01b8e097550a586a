import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from variscope.session import session

    s = session("variscope-tests", "8", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def source(spark):
    """Lines of one or more small files."""

    def make(*texts):
        rows = [(i, n + 1, line) for i, text in enumerate(texts) for n, line in enumerate(text.strip("\n").split("\n"))]
        return spark.createDataFrame(rows, "file_id long, line_no long, txt string")

    return make
