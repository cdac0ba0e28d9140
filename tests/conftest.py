"""Shared session, paths and small fixtures."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from prepflow.session import CHECKPOINT_CONF, local_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {
        "spark.sql.shuffle.partitions": "4",
        # Small tables would be merged to one partition, and nothing would be split.
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    session = local_session(4, "prepflow-tests", **conf)
    if not session.conf.get(CHECKPOINT_CONF, None):
        session.conf.set(CHECKPOINT_CONF, str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def nulls(spark):
    """Nulls everywhere but in ``id``, one all-null group and one one-row group."""
    return spark.createDataFrame(
        [
            (1, "a", 5, 1.5, "x"),
            (2, "a", None, 2.5, None),
            (3, "a", 7, None, "y"),
            (4, "b", None, None, None),
            (5, "b", None, None, None),
            (6, None, 9, 4.0, "z"),
            (7, "c", 1, 8.0, "x"),
            (8, "a", 5, 1.5, "x"),
        ],
        "id bigint, g string, x bigint, d double, s string",
    )


@pytest.fixture
def write_csv(tmp_path):
    """Write a text file and give its path."""

    def write(name: str, text: str) -> str:
        path = tmp_path / name
        path.write_text(text, encoding="utf-8")
        return str(path)

    return write


def rows(df, *order):
    """Rows as tuples, sorted if names are given."""
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
