import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    # a small driver heap, like a default session: plan or driver-side memory
    # growth shows up here instead of on a cluster
    os.environ.setdefault("MODERATA_DRIVER_MEM", "2g")
    from moderata.session import local_session
    s = local_session("*", 8, "moderata-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb
    from check_oracle import duck_views
    con = duckdb.connect()
    duck_views(con, SF01)
    return con
