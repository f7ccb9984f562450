import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tesoro.session import local_session_for_tests
    s = local_session_for_tests()
    yield s
    s.stop()


def rows(df, *cols):
    """Collect selected columns as a sorted list of tuples (tests only)."""
    sel = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in sel.collect()), key=repr)
