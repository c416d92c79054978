import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from faultlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def make_files(spark):
    """Build a files table from ``{path: content}``."""

    def build(contents, project="p"):
        rows = [(project, path, False, len(text.encode()), text) for path, text in contents.items()]
        return spark.createDataFrame(
            rows, "project string, path string, is_dir boolean, size long, content string"
        )

    return build
