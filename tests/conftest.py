from __future__ import annotations

import pytest

from quillmark.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    yield s
    s.stop()
