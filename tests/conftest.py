from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from groundtally.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("tests", "local[4]", spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")), spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__enabled="false",
                      spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def raster(spark):
    """Builds a pixel table from {patch: list of rows of codes}."""
    def build(patches):
        rows = [(p, r, c, int(code)) for p, grid in patches.items() for r, line in enumerate(grid) for c, code in enumerate(line)]
        return spark.createDataFrame(rows, "patch_id int, row int, col int, code int")
    return build
