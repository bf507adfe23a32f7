from pathlib import Path

import pytest

from matchloom import runtime as R


def test_tables_go_with_their_result(spark):
    folder = Path(R.shared_folder(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    with R.released(spark):
        kept = R.stored(spark.range(5))
        with R.released(spark):
            assert R.stored(kept).count() == 5
        assert kept.count() == 5 and len(set(folder.iterdir()) - before) == 1
        other = R.stored(spark.range(3))
        R.dropped(other)
    assert set(folder.iterdir()) == before


def test_no_local_folder_on_a_cluster():
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        sparkContext = Context()
        conf = {}  # noqa: RUF012

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        R.shared_folder(Session())


def test_salted_join_keeps_every_row(spark):
    large = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 1), (None, 1)], "k int, x int")
    small = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "k int, y string")
    for rows in (7, 1000):
        assert R.salted_join(large, small, ["k"], rows=rows).count() == 100
    assert R.salted_join(large.limit(0), small, ["k"]).count() == 0


def test_stored_tables_leave_no_garbage_on_the_driver(spark):
    def full() -> int:
        return sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Young" not in b.getName())

    before = full()
    assert R.stored(spark.range(3)).count() == 3
    assert full() > before
