import pathlib
import threading

from opinara.session import Scratch, cut_lineage


def files(table):
    return [pathlib.Path(f.removeprefix("file://").removeprefix("file:")) for f in table.inputFiles()]


def test_tables_belong_to_the_work_that_wrote_them(spark):
    before = cut_lineage(spark.range(3), "before")
    with Scratch(spark) as outer:
        a = cut_lineage(spark.range(4), "a")
        with Scratch(spark) as inner:
            b = cut_lineage(spark.range(5), "b")
            c = inner.store(spark.range(6), "c")
            inner.clear(c)
        d = cut_lineage(spark.range(7), "d")
        gone = files(d)
        outer.drop(d)
    assert [before.count(), a.count(), c.count()] == [3, 4, 6]
    assert not any(f.exists() for f in gone) and not b.inputFiles() or not files(b)[0].exists()
    assert [t for t, _ in outer.tables] == [a] and [t for t, _ in inner.tables] == [c]


def test_work_in_two_threads_keeps_its_own_tables(spark):
    ready, found = threading.Barrier(2), {}

    def work(n):
        with Scratch(spark) as own:
            kept = cut_lineage(spark.range(n), f"kept{n}")
            cut_lineage(spark.range(n + 1), f"gone{n}")
            ready.wait()
            own.clear(kept)
            ready.wait()
            found[n] = (kept.count(), len(own.tables))

    threads = [threading.Thread(target=work, args=(n,)) for n in (10, 20)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert found == {10: (10, 1), 20: (20, 1)}
