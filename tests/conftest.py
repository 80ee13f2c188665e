import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from strata.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    import tempfile
    s = local_session(cores="*", shuffle_partitions=8, app="strata-tests",
                      extra={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="strata-wh-")})
    yield s
    s.stop()


@pytest.fixture
def tmp_dir(tmp_path):
    return str(tmp_path)
