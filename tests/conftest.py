import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quietwire.session import build_session

    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false",
        "spark.sql.autoBroadcastJoinThreshold": "1m",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def packet_frame(spark):
    from quietwire.schema import PACKET

    def make(*rows):
        """Rows of (ts, src, dst, sport, dport, protocol, length, payload, flags)."""
        return spark.createDataFrame([(i, float(r[0]), *r[1:]) for i, r in enumerate(rows)], PACKET)

    return make
