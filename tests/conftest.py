import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quarry.session import importable, local_session

    s = local_session("tests", cores=4, partitions=4, **{"spark__checkpoint__dir": str(tmp_path_factory.mktemp("shared"))})
    importable(s)
    yield s
    s.stop()
