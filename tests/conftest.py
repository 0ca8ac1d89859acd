import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tripforge.session import build_session

    shared = str(tmp_path_factory.mktemp("shared"))
    s = build_session("tests", "local[4]", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_checkpoint_dir=shared, spark_sql_warehouse_dir=f"{shared}/warehouse", spark_driver_memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
