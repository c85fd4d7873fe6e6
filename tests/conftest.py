from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[4]").appName("tests")
    for key, value in (("spark.sql.shuffle.partitions", "4"), ("spark.ui.enabled", "false"), ("spark.sql.session.timeZone", "UTC"), ("spark.driver.memory", "3g"), ("spark.ui.showConsoleProgress", "false")):
        builder = builder.config(key, value)
    s = builder.getOrCreate()
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
