import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from dossier import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.build("tests", f"local[{os.environ.get('TEST_CPUS', '8')}]", 8)
    s.sparkContext.setLogLevel("ERROR")
    session.prepare(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
