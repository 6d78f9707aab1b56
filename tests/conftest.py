import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tracklight.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build(
        "tests",
        "local[8]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Make a DataFrame from dicts; columns of the schema that are not given are NULL."""

    def make(schema, rows):
        names = schema.fieldNames()
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)

    return make


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks of four rows, so that small inputs run over many blocks."""
    from tracklight.plans import scans

    monkeypatch.setattr(scans, "BLOCK_BITS", 2)


@pytest.fixture(scope="module", autouse=True)
def nothing_left_cached(spark):
    """Tables that a module caches would answer the scans of those after it."""
    yield
    spark.catalog.clearCache()
