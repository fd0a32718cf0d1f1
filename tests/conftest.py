import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from codelake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("local[*]", **{"spark.sql.shuffle.partitions": "4",
                                        "spark.driver.memory": "8g"})


@pytest.fixture
def files(spark):
    """make(path -> text) gives a frame of files of one project."""
    from codelake.sources.scan import detect_language

    def make(texts, project="p"):
        rows = [(project, path, text) for path, text in texts.items()]
        return detect_language(spark.createDataFrame(
            rows, "project_id string, file_path string, content string"))
    return make
