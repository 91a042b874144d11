import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from prosodia.session import session

    spark = session("tests", "local[4]", 4, spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")))
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
