"""Every query of the library against its SQL on the small tables."""

import os
from pathlib import Path

import pytest
from oracle import expected, rows

from foliant.plans import registry, stream_plans

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    assert rows(registry.queries()[name](spark, FOLDER).toPandas()) == rows(expected(registry.oracle_sql()[name], FOLDER))


def test_ingest_has_files_of_one_lot_at_a_time(spark, monkeypatch):
    """All documents are taken in, but the files that lie there at once are a part of them; in the end none is left."""
    run, there = stream_plans.pr.stream_ingest, []

    def counted(spark, path, *rest):
        there.append((len(list(Path(path.removeprefix("file:")).rglob("*.txt"))), path))
        return run(spark, path, *rest)

    monkeypatch.setattr(stream_plans, "LOT", 1 << 14)
    monkeypatch.setattr(stream_plans, "LOTS", 3)
    monkeypatch.setattr(stream_plans.pr, "stream_ingest", counted)
    name = "k4_stream_ingest"
    got = rows(registry.queries()[name](spark, FOLDER).toPandas())
    assert got == rows(expected(registry.oracle_sql()[name], FOLDER))
    files = [n for n, _ in there]
    assert len(files) == 6 and sum(files) == 2 * 200 and max(files) < 100
    assert not [x for _, path in there for x in Path(path.removeprefix("file:")).rglob("*.txt")]


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, FOLDER).count() > 0
