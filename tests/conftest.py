import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from weftline.session import session  # noqa: E402
from weftline.streaming.events import STATE_STORE  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", 4, spark__driver__memory="4g", spark__ui__showConsoleProgress="false", **{STATE_STORE[0]: STATE_STORE[1]})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def rows(spark):
    """Sorted tuples of a DataFrame."""
    return lambda df, *columns: sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
