import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
# Python workers import the package.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))
sys.path.insert(0, ROOT)

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents of (id, text) or (id, text, lang, source), in a few partitions."""

    def make(rows, extra: str = "", parts: int = 3):
        full = [(*row, *("en", "a")[len(row) - 2 :], len(row[1] or "")) for row in rows]
        df = spark.createDataFrame(full, DOCUMENT)
        for name in extra.split():
            df = df.selectExpr("*", f"doc_id AS {name}")
        return df.repartition(parts)

    return make
