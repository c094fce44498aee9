"""Pages of a sorted table and the files that they open."""

import pytest
from pyspark.sql import functions as F

from tidewater.operators import paging


@pytest.fixture(scope="module")
def sorted_table(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('paged')}/table"
    rows = spark.range(1000).select((F.col("id") * 7 % 10).alias("day"), F.col("id"), F.lit("x").alias("low")).repartition(3)
    paging.write_sorted(rows, path, ["day", "id"], 100)
    return path


EXPECTED = sorted((i * 7 % 10, i) for i in range(1000))


def keys(df):
    return [(r.day, r.id) for r in df.collect()]


def test_zones_tile_the_table(spark, sorted_table):
    zones = sorted(paging.zones(spark, sorted_table).collect(), key=lambda z: z.before)
    assert sum(z.rows for z in zones) == 1000 and len(zones) >= 10 and max(z.rows for z in zones) <= 100
    assert [z.before for z in zones] == [sum(y.rows for y in zones[:i]) for i in range(len(zones))]
    assert all(a.high < b.low for a, b in zip(zones, zones[1:], strict=False))


@pytest.mark.parametrize("number,size", [(1, 30), (4, 30), (20, 50), (34, 30), (7, 150), (1, 2000), (35, 30), (10**9, 30)])
def test_a_page_opens_its_files_only(spark, sorted_table, number, size):
    page = paging.page(spark, sorted_table, number, size)
    start = (number - 1) * size
    assert keys(page) == EXPECTED[start : start + size] and page.columns == ["day", "id", "low"]
    zones = paging.zones(spark, sorted_table).collect()
    hold = {z.file for z in zones if z.before < start + size and z.before + z.rows > start}
    assert {f.rsplit("/", 1)[-1] for f in page.inputFiles()} == hold and (size > 30 or len(hold) <= 2)


@pytest.mark.parametrize("last", [(-1, 0), (0, 0), (3, 449), (3, 450), (5, 10**6), (9, 996), (9, 997), (99, 0)])
def test_pages_after_a_key(spark, sorted_table, last):
    page = paging.page_after(spark, sorted_table, last, 40)
    assert keys(page) == [k for k in EXPECTED if k > last][:40] and len(page.inputFiles()) <= 3


def test_all_pages_in_turn(spark, sorted_table):
    last, seen = (-1, 0), []
    while found := keys(paging.page_after(spark, sorted_table, last, 170)):
        seen += found
        last = found[-1]
    assert seen == EXPECTED


def test_empty_tables_and_wrong_pages(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    paging.write_sorted(spark.createDataFrame([], "day int, id int"), path, ["day", "id"])
    assert paging.page(spark, path, 1, 10).count() == 0 and paging.page_after(spark, path, (1, 1), 10).count() == 0
    with pytest.raises(ValueError):
        paging.page(spark, path, 0, 10)
