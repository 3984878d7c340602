from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lorekeep.session import session

    s = session("tests", cpus=4, shuffle_partitions=4, extra={"spark.driver.memory": "4g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("scratch")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    yield s
    s.stop()
