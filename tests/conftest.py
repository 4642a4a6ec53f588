"""One small local session for all tests."""

from __future__ import annotations

import pytest

from fieldbook.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        spark_sql_shuffle_partitions="4",
        spark_driver_memory="4g",
        spark_ui_enabled="false",
        spark_ui_showConsoleProgress="false",
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
