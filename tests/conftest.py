from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from gnomon.session import session

    return session("local[4]", spark_sql_shuffle_partitions="4", spark_driver_memory="3g")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
