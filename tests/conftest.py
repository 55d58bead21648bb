import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.dirname(__file__)), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", f"file://{folder}/warehouse").config("spark.checkpoint.dir", f"file://{folder}/shared").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
