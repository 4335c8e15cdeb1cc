"""Stored payloads: what is written is read back, and only where it is needed."""

import re

import pytest

from offerloom.sources import stored

PAYLOADS = "source string, query string, page bigint, status int, body string"
DM = '{"products":[{"gtin":1,"title":"T","tileData":{"self":"/s","trackingData":{"price":%s}}}]}'
ROWS = [
    ("dm", "q", 0, 200, DM % "12.5"),
    ("dm", "q", 1, 200, DM % "7"),
    ("dm", "r", 0, 503, DM % "1"),
    ("sezamo", "q", 0, 200, '{"data":{"productList":[{"productId":5,"productName":"S","baseLink":"b","categories":[{"nameId":"c"}],"price":{"full":9.5}}]}}'),
    ("emag", "q", 0, 200, ""),
    ("notino", None, None, None, None),
    (None, "q", 0, 200, "x"),
]


@pytest.mark.parametrize("form", ["json", "parquet"])
def test_round_trip(spark, tmp_path, form):
    stored.write_payloads(spark.createDataFrame(ROWS, PAYLOADS), str(tmp_path / "p"), form)
    back = stored.read_payloads(spark, str(tmp_path / "p"), form)
    assert back.columns == stored.COLUMNS
    want = [(s, q, p or 0, n, b, None) for s, q, p, n, b in ROWS]
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(want, key=repr)
    told = {(r.source, r.query, r.page): r.error for r in stored.stored_status(back).collect()}
    assert told == {("dm", "q", 0): None, ("dm", "q", 1): None, ("dm", "r", 0): "HTTP 503", ("sezamo", "q", 0): None, ("emag", "q", 0): "blocked", ("notino", None, 0): "unknown", (None, "q", 0): None}
    found = stored.stored_offers(spark, str(tmp_path / "p"), form=form)
    assert sorted((r.source, r.id, r.price) for r in found.collect()) == [("dm", "dm-1", 7.0), ("dm", "dm-1", 12.5), ("sezamo", "sezamo-5", 9.5)]
    # a second fetch is added to the first
    stored.write_payloads(spark.createDataFrame(ROWS[:1], PAYLOADS), str(tmp_path / "p"), form)
    assert stored.read_payloads(spark, str(tmp_path / "p"), form).count() == len(ROWS) + 1


def test_without_pages(spark, tmp_path):
    rows = spark.createDataFrame([(s, q, n, b, "more") for s, q, _, n, b in ROWS[:1]], "source string, query string, status int, body string, problem string")
    stored.write_payloads(rows, str(tmp_path / "p"))
    assert [tuple(r) for r in stored.read_payloads(spark, str(tmp_path / "p")).collect()] == [("dm", "q", 0, 200, ROWS[0][4], None)]


def test_broken_lines_are_told(spark, tmp_path):
    folder = tmp_path / "p" / "source=dm"
    folder.mkdir(parents=True)
    lines = ['{"query":"q","page":0,"status":200,"body":"{}"}', "{broken", '{"query":"r","page":0,"status":"many","body":"b"}', ""]
    (folder / "a.json").write_text("\n".join(lines))
    back = stored.read_payloads(spark, str(tmp_path / "p"))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted([("dm", "q", 0, 200, "{}", None), ("dm", None, None, None, None, "{broken"), ("dm", None, None, None, None, lines[2])], key=repr)
    assert sorted(r.error or "" for r in stored.stored_status(back).collect()) == ["", "unreadable", "unreadable"]
    assert [(r.source, r.n, r.example) for r in stored.unreadable(back).collect()] == [("dm", 2, "{broken" if "{broken" < lines[2] else lines[2])]


@pytest.mark.parametrize("form", ["json", "parquet"])
def test_each_reader_scans_its_partition(spark, tmp_path, form):
    stored.write_payloads(spark.createDataFrame(ROWS, PAYLOADS), str(tmp_path / "p"), form)
    made = stored.stored_offers(spark, str(tmp_path / "p"), ["dm"], form)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*source#\d+ = dm", plan)
    assert len(re.findall("FileScan", plan)) == 1
    assert sorted(r.id for r in made.collect()) == ["dm-1", "dm-1"]
    # and so do all of them
    every = stored.stored_offers(spark, str(tmp_path / "p"), form=form)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan", every)) == len(re.findall(r"PartitionFilters: \[[^\]]*source#\d+ = ", every))


def test_unknown_sources(spark, tmp_path):
    for sources in (["shop"], []):
        with pytest.raises(ValueError):
            stored.stored_offers(spark, str(tmp_path), sources)
