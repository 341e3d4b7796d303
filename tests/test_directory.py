"""Pages and listed positions by bucket directory equal whole-table numbering."""

import pytest
from pyspark.sql import functions as F

from tabprobe.operators import ordering, positions


@pytest.fixture
def shuffled(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", 50)
    # missing keys, and one key that holds a third of the rows; (k, id) is unique
    k = F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 40)
    return spark.range(1000).select("id", k.alias("k"), F.xxhash64("id").alias("h")).orderBy("h").drop("h")


def _ids(df):
    return {r["row_id"]: r["id"] for r in df.collect()}


def test_same_rows_as_whole_numbering(shuffled):
    order = ["k", "id"]
    want = _ids(ordering.with_row_id(shuffled, order))
    assert sorted(want) == list(range(1000))
    for spec in ("0", "999", "3-5,400-420,998-2000", "0-999"):
        mine = {x for lo, hi in positions.parse_index_spec(spec) for x in range(lo, hi + 1)}
        assert _ids(positions.preview_rows_by_index(shuffled, spec, order_by=order)) == {p: i for p, i in want.items() if p in mine}
    kept = _ids(positions.keep_rows_by_index(shuffled, "5,7,1000", order_by=order))
    assert kept == {0: want[5], 1: want[7]}
    for page, lo in ((1, 0), (4, 300), (99, 900), (-1, 0)):
        assert _ids(positions.page_rows(shuffled, page, 100, order_by=order)) == {p: want[p] for p in range(lo, lo + 100)}


def test_only_buckets_of_the_page_are_numbered(shuffled):
    where = ordering.Directory(shuffled, ["id"])
    assert where.rows == 1000 and len(where.starts) >= 15
    found = where.touched([(500, 509)])
    assert 1 <= len(found) <= 2
    sizes = {b: hi - lo for b, lo, hi in where.starts}
    assert where.number([(500, 509)]).count() == sum(sizes[b] for b, _ in found) < 250


def test_empty_table_and_positions_beyond(shuffled):
    none = shuffled.limit(0)
    assert positions.page_rows(none, 3, 10, order_by=["id"]).count() == 0
    assert positions.keep_rows_by_index(none, "1", order_by=["id"]).count() == 0
    assert positions.keep_rows_by_index(shuffled, "5000", order_by=["id"]).count() == 1000
