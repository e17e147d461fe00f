from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from matchengine.session import local_session

    session = local_session(cores=4, partitions=4, memory="3g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA
