from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text), with the other columns of the table and one that clashes with internal names."""

    def build(rows: list[tuple]):
        return spark.createDataFrame([(k, t, "en" if i % 2 else None, f"s{i % 2}", len(t or ""), "x") for i, (k, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, kept string").repartition(3)

    return build
