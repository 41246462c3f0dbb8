from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

from ledgerloom import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="6g",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def table(spark, request):
    """A table name of the test's own; its table is dropped afterwards."""
    names: list[str] = []

    def make(suffix: str = "t") -> str:
        name = f"{request.node.name.split('[')[0]}_{suffix}".lower()
        drop_all(spark, name)
        names.append(name)
        return name

    yield make
    for name in names:
        drop_all(spark, name)


def drop_all(spark, prefix=""):
    """Drop every table and view whose name begins so."""
    for t in spark.catalog.listTables():
        if t.name.startswith(prefix) and not t.isTemporary:
            spark.sql(f"DROP {'VIEW' if t.tableType == 'VIEW' else 'TABLE'} IF EXISTS {t.name}")


def rows(df, *columns):
    """Rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))
