import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture()
def docs(spark):
    """rows (doc_id, text) -> a documents table with extra, clashing columns."""
    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", "s", 0, "x", 1) for i, t in rows],
            "doc_id long, text string, lang string, source string, n_chars long, Text string, id long")
    return make
