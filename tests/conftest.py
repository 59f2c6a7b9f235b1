import os
import sys
from datetime import datetime, timezone

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.compare import session  # noqa: E402
from wirebook.session import configure  # noqa: E402

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
EDGE_DDL = (
    "src_ip string, dst_ip string, protocol string, port int, function_code string, first_seen timestamp, "
    "last_seen timestamp, packet_count bigint, avg_interval_ms double, is_periodic boolean"
)


@pytest.fixture(scope="session")
def spark():
    spark = configure(session("4", **{"spark.sql.shuffle.partitions": "4"}))
    yield spark
    spark.stop()


@pytest.fixture
def edges(spark):
    """Edges out of short tuples; times are seconds after T0."""

    def make(*rows):
        full = []
        for src, dst, protocol, port, code, first, last, count, *rest in rows:
            gap = rest[0] if rest else ((last - first) * 1000.0 / (count - 1) if count > 1 else 0.0)
            periodic = count > 1 and 100 <= gap <= 1000
            full.append((src, dst, protocol, port, code, at(first), at(last), count, gap, periodic))
        return spark.createDataFrame(full, EDGE_DDL)

    return make


def at(seconds):
    return datetime.fromtimestamp(T0.timestamp() + seconds, timezone.utc)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
