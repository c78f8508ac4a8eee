import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessera.session import session

    where = tmp_path_factory.mktemp("spark")
    s = session(
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="3g",
        spark__checkpoint__dir=f"file://{where}/shared",
        spark__sql__warehouse__dir=f"{where}/warehouse",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
