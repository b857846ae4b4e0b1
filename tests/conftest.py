import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ligneo.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4, app="tests", driver_memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def specs(spark):
    from ligneo.plans.specs import demo_specs

    return demo_specs(spark)


@pytest.fixture
def lines_of(spark):
    """Lines from (file_path, format, [text, ...]), numbered from 1."""

    def build(*files):
        rows = [
            (path, path.rsplit("/", 1)[-1], i + 1, name, text)
            for path, name, texts in files for i, text in enumerate(texts)
        ]
        return spark.createDataFrame(rows, "file_path string, file_name string, line_no bigint, format string, line string")

    return build
