"""The commit log: writers that die, numbers half written, several tables at once, cleaning."""

import pytest
from pyspark.sql import functions as F

from sparkshelf.sources import writers as W


def test_a_writer_that_dies_between_write_and_rename(spark, tmp_path, monkeypatch):
    store = W.Store(spark, f"file://{tmp_path}/s")
    store.write({"a": spark.range(3)})
    real = store._gone = W.Store._commit

    class Died(Exception):
        pass

    def dies(self, number, entry):
        fs, made = self._fs(f"{self.path}/_commits/.dead")
        out = fs.create(made, False)
        out.write(bytearray('{"a": "ha', "ascii"))
        out.close()
        raise Died

    monkeypatch.setattr(W.Store, "_commit", dies)
    with pytest.raises(Died):
        store.update(lambda read: {"a": read("a").union(spark.range(10, 12))})
    monkeypatch.setattr(W.Store, "_commit", real)
    assert store.read("a").count() == 3
    store.update(lambda read: {"a": read("a").union(spark.range(10, 12))})
    assert store.read("a").count() == 5 and [n for n, _ in store.log()] == [0, 1]


@pytest.mark.parametrize("content", ["", '{"a": "fol', "[1]", "folder."])
def test_a_number_that_was_half_written_is_stepped_over(spark, tmp_path, content):
    store = W.Store(spark, f"file://{tmp_path}/s")
    store.write({"a": spark.range(3)})
    (tmp_path / "s/_commits/000000001").write_text(content)
    assert store.read("a").count() == 3
    store.update(lambda read: {"a": read("a").union(spark.range(2))})
    assert store.read("a").count() == 5 and [n for n, _ in store.log()] == [0, 2] and store.read("a", 1).count() == 3


def test_one_commit_over_several_tables(spark, tmp_path):
    store = W.Store(spark, f"file://{tmp_path}/s")
    store.write({"a": spark.range(2), "b": spark.range(3)})
    with pytest.raises(Exception, match="boom"):
        store.write({"a": spark.range(9), "b": spark.range(1).withColumn("x", F.raise_error(F.lit("boom")))})
    assert (store.read("a").count(), store.read("b").count()) == (2, 3)
    other = W.Store(spark, f"file://{tmp_path}/s")

    def change(read):
        if read("b").count() == 3:  # another writer changes b meanwhile
            other.write({"b": spark.range(30)})
        return {"a": read("a").union(read("b"))}

    store.update(change)
    assert (store.read("a").count(), store.read("b").count()) == (32, 30)
    store.rollback()
    assert (store.read("a").count(), store.read("b").count()) == (2, 30) and store.read("c") is None


def test_cleaning_keeps_what_is_named(spark, tmp_path):
    t = W.Versioned(spark, f"file://{tmp_path}/t")
    assert t.clean() == 0
    for n in range(5):
        t.write(spark.range(n + 1))
    t._stored(spark.range(7))  # of a writer that died
    (tmp_path / "t/_commits/.dead").write_text("x")
    assert t.clean(keep=2, hours=1) == 0 and len(t.versions()) == 2  # the log is cut, folders are too young
    assert t.clean(keep=2, hours=0) == 4
    assert t.read().count() == 5 and t.read(1).count() == 4 and t.read(2) is None
    assert not (tmp_path / "t/_commits/.dead").exists()
    t.write(spark.range(9))
    assert t.read().count() == 9 and t.store.log()[-1][0] == 5
    with pytest.raises(ValueError):
        t.clean(keep=0)


def test_nothing_to_roll_back_to(spark, tmp_path):
    t = W.Versioned(spark, f"file://{tmp_path}/t")
    t.write(spark.range(1))
    with pytest.raises(ValueError):
        t.rollback()
