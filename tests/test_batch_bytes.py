"""Registered queries hand their Python workers batches of a bounded size."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiscope import session
from lexiscope.plans.queries import QUERIES

KEYS = [key for key, _, _ in session._BATCHES]


@pytest.fixture
def limit(spark):
    before = {key: spark.conf.get(key) for key in KEYS}
    for key in KEYS:
        spark.conf.unset(key)
    yield spark
    for key, own in before.items():
        spark.conf.set(key, own)


def test_batches_are_bounded(limit):
    from conftest import SF001
    QUERIES["token_pair_counts"][0](limit, SF001)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    texts = limit.range(0, 9000, 1, 1).selectExpr("repeat(char(65 + id % 26), 2000) AS text")
    got = texts.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 9000 and max(r["n"] for r in got) <= session.BATCH_ROWS
    assert max(r["size"] for r in got) < session.BATCH_BYTES + (1 << 20)

    @F.arrow_udf("long")
    def seen(texts: pa.Array) -> pa.Array:
        return pa.array([texts.nbytes] * len(texts))

    long = limit.range(0, 300, 1, 1).selectExpr("repeat(char(65 + id % 26), 100000) AS text")
    assert long.select(F.max(seen("text"))).first()[0] < session.BATCH_BYTES + (1 << 20)


def test_limits_of_the_callers_own_stay(limit):
    for key in KEYS:
        limit.conf.set(key, 777)
    session.bounded_batches(limit)
    assert [int(limit.conf.get(key).rstrip("b")) for key in KEYS] == [777, 777]
