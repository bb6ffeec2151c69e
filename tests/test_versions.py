"""The commit log: whole versions only, and no lost update."""

from __future__ import annotations

import threading

import pytest
from market import marketplace, rows, translation

from stallwise.plans.products_audit import NEW_TRANSLATIONS, commit_translations
from stallwise.sources.versions import VersionConflict, VersionLog


@pytest.fixture
def log(spark, tmp_path):
    return VersionLog(spark, str(tmp_path / "table"))


def table(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def test_versions_stay_readable(spark, log):
    assert log.latest() == 0 and log.versions() == []
    assert log.commit(table(spark, 1), 0, by="a") == 1
    assert log.commit(table(spark, 1, 2), 1) == 2
    assert sorted(rows(log.read())) == [(1,), (2,)] and rows(log.read(1)) == [(1,)]
    assert log.entry(1)["by"] == "a" and log.entry(2)["base"] == 1
    with pytest.raises(ValueError, match="no version 3"):
        log.read(3)


def test_data_without_an_entry_is_never_read(spark, log):
    """A writer that dies between its files and its entry leaves nothing behind that counts."""
    log.commit(table(spark, 1), 0)
    log.write_data(table(spark, 99))
    assert log.latest() == 1 and rows(log.read()) == [(1,)]
    assert log.update(lambda df: df.union(table(spark, 2))) == 2
    assert sorted(rows(log.read())) == [(1,), (2,)]


def test_an_unfinished_entry_is_not_a_version(spark, log, tmp_path):
    log.commit(table(spark, 1), 0)
    (tmp_path / "table" / "log" / ".half").write_text('{"version": 2, "da')
    assert log.latest() == 1 and log.commit(table(spark, 2), 1) == 2


def test_only_one_of_two_writers_gets_a_number(spark, log, tmp_path):
    log.commit(table(spark, 1), 0)
    log.commit(table(spark, 1, 2), 1)
    with pytest.raises(VersionConflict):
        log.commit(table(spark, 1, 3), 1)
    assert sorted(rows(log.read())) == [(1,), (2,)]
    assert len(list((tmp_path / "table" / "data").iterdir())) == 2
    assert not [p for p in (tmp_path / "table" / "log").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_racing_writers_lose_nothing(spark, log):
    log.commit(table(spark, 0), 0)
    together = threading.Barrier(4)

    def add(value):
        def change(df):
            if change.first:
                change.first = False
                together.wait()  # all have read version 1
            return df.union(table(spark, value))

        change.first = True
        log.update(change)

    writers = [threading.Thread(target=add, args=(value,)) for value in range(1, 5)]
    for writer in writers:
        writer.start()
    for writer in writers:
        writer.join(120)
    assert sorted(rows(log.read())) == [(v,) for v in range(5)] and log.versions() == [1, 2, 3, 4, 5]


def test_racing_upserts(spark, log):
    """Two writers of the same rows and one of another: each row is there once."""
    first = marketplace(spark, category_translation=[translation("a", "A"), translation(None, "none")]).category_translation
    changes = [NEW_TRANSLATIONS, NEW_TRANSLATIONS, (("b", "B"),)]
    writers = [threading.Thread(target=commit_translations, args=(log, first, change)) for change in changes]
    for writer in writers:
        writer.start()
    for writer in writers:
        writer.join(120)
    assert sorted(rows(log.read()), key=str) == sorted([("a", "A"), (None, "none"), ("b", "B"), *NEW_TRANSLATIONS], key=str)
    before = log.versions()
    assert commit_translations(log, first, (("b", "B"),)) == before[-1] and log.versions() == before


def test_conflicting_rows_commit_nothing(spark, log):
    first = marketplace(spark).category_translation
    with pytest.raises(Exception, match="conflicting rows"):
        commit_translations(log, first, (("x", "1"), ("x", "2")))
    assert log.latest() == 0
