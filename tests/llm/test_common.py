"""Stored tables and their deletion, and components after it."""

import os

import pyarrow as pa

from lendscope.llm import common
from lendscope.llm.common import components, discard, stored


def test_discarded_tables_are_gone_and_others_stay(spark):
    one, two = stored(spark.range(5)), stored(spark.range(7))
    where = one._lendscope_folder.removeprefix("file:")
    assert os.path.isdir(where)
    discard(one)
    assert not os.path.exists(where) and two.count() == 7


def test_components_leave_only_their_result(spark):
    chain = spark.range(40).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(100, 101), (101, 99)], "a long, b long"))
    labels = components(chain)
    base = os.path.dirname(labels._lendscope_folder.removeprefix("file:"))
    before = set(os.listdir(base))
    again = components(chain)
    assert {tuple(r) for r in labels.collect()} == {tuple(r) for r in again.collect()} == {(i, 0) for i in range(41)} | {(i, 99) for i in (99, 100, 101)}
    # The result and the last, empty edges.
    assert len(set(os.listdir(base)) - before) == 2


def test_a_task_gives_memory_back_when_it_ends_or_is_left(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    task = common.released(lambda batches: (b * 2 for b in batches))
    assert list(task(iter([1, 2]))) == [2, 4] and given == [1]
    left = task(iter([1, 2]))
    assert next(left) == 2 and given == [1]
    left.close()
    assert given == [1, 1]


def test_workers_give_their_memory_back(spark):
    # Plain mapInArrow, so that the figures are those a worker starts its next task with.
    def held(batches):
        pool = pa.default_memory_pool()
        kept = [pa.array(range(100_000), pa.int64()) for _ in range(20)]
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pool.bytes_allocated() >= len(kept) * 800_000] * b.num_rows)], names=["held"])

    def left(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pa.default_memory_pool().bytes_allocated()] * b.num_rows, pa.int64())], names=["bytes"])

    rows = spark.range(4, numPartitions=1)
    assert {r["held"] for r in common.arrow_map(rows, held, "held boolean").collect()} == {True}
    assert max(r["bytes"] for r in rows.mapInArrow(left, "bytes long").collect()) < 1_000_000
