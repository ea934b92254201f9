"""Published sets: a stop after any table leaves the set before it readable."""
import pytest

from surveykit.sources.sinks import PublishedSet


def test_sets_switch_as_a_whole(spark, tmp_path):
    store = PublishedSet(spark, str(tmp_path / "out"))
    assert store.current() is None
    tables = lambda n: {x: spark.range(n * k).toDF("v") for k, x in enumerate("abc", 1)}
    first = store.publish(tables(2))
    counts = lambda: [store.read(x).count() for x in "abc"]
    assert store.current() == first and counts() == [2, 4, 6]
    assert [(t["table"], t["rows"]) for t in store.manifest()["tables"]] == [("a", 2), ("b", 4), ("c", 6)]
    for stop in range(3):  # a run that fails at its first, second, third table
        broken = {x: df.selectExpr("raise_error('stop') as v") if k == stop else df for k, (x, df) in enumerate(tables(5).items())}
        with pytest.raises(Exception, match="stop"):
            store.publish(broken)
        assert store.current() == first and counts() == [2, 4, 6]
    names = [first] + [store.publish(tables(n)) for n in (3, 4, 5)]
    assert counts() == [5, 10, 15] and store.manifest()["before"] == [names[2], names[1]]
    assert store.read("a", names[1]).count() == 3  # a reader that began on an older set
    assert not (tmp_path / "out" / first).exists()
