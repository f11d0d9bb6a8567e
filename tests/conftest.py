import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lamina.session import session

    return session("local[4]", **{"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"})


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.01"
