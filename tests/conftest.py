from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from vitrine.session import build_session, checkpoint_dir

    warehouse = tempfile.mkdtemp(prefix="vitrine-wh-")
    s = build_session("local[4]", shuffle_partitions=8, app_name="vitrine-tests", extra={
        "spark.sql.warehouse.dir": warehouse,
        "spark.driver.extraJavaOptions": f"-Dderby.system.home={warehouse}",
    })
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture
def scratch():
    return tempfile.mkdtemp(prefix="vitrine-test-")
