import os

import pytest

from plumbline.session import session

FOLDER = os.environ.get("PLUMBLINE_TABLES", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[8]", spark__sql__shuffle__partitions="4", spark__driver__memory="6g",
                spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture
def rows():
    """Collected rows as a sorted list of plain tuples."""
    def get(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=lambda r: [(v is None, str(v)) for v in r])
    return get
