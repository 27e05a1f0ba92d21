import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from shroud.session import local_session
    s = local_session("*", shuffle_partitions=8, app="shroud-tests")
    yield s
    s.stop()


SF_SMALL = "/root/testdata/sf0.001"
