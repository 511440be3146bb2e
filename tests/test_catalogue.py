"""File catalogue, ranked reads and per-file decoding, on files written by hand."""

import pytest

from pricelens.sources import catalogue as cat
from pricelens.sources import ingest


def _put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))


def test_catalogue_counts_a_file_once_for_its_first_root(spark, tmp_path):
    _put(tmp_path / "raw" / "deep" / "a.csv", "x\n1\n")
    _put(tmp_path / "raw" / "b.csv", "x\n12\n")
    _put(tmp_path / "c.csv", "x\n123\n")
    _put(tmp_path / "raw" / "d.txt", "no dump")
    files = cat.file_catalogue(spark, [str(tmp_path / "none"), str(tmp_path / "raw"), str(tmp_path)])
    got = {r["name"]: (r["size"], r["depth"], r["root_rank"]) for r in files.collect()}
    assert got == {"a.csv": (4, 1, 1), "b.csv": (5, 0, 1), "c.csv": (6, 0, 2)}
    ranks = {r["label"]: r["source_rank"] for r in cat.largest_first(cat.sources(files)).collect()}
    assert ranks == {"c.csv": 1, "b.csv": 2, "a.csv": 3}


def test_main_dump_by_root_then_pattern_then_size(spark, tmp_path):
    _put(tmp_path / "raw" / "deep" / "ks-projects.csv", "x\n1\n" * 99)  # below the root, not in it
    _put(tmp_path / "raw" / "other.csv", "x\n1\n" * 50)
    _put(tmp_path / "raw" / "kickstarter1.csv", "x\n1\n")
    _put(tmp_path / "raw" / "kickstarter2.csv", "x\n1\n2\n")
    _put(tmp_path / "ks-projects-big.csv", "x\n1\n" * 99)
    src = cat.sources(cat.file_catalogue(spark, [str(tmp_path / "raw"), str(tmp_path)]))
    assert cat.pick_dump(src).endswith("/raw/kickstarter2.csv")
    none = cat.sources(cat.file_catalogue(spark, [str(tmp_path / "none")]))
    assert cat.pick_dump(none) is None
    assert cat.read_ranked(spark, cat.largest_first(none), "source_rank", "x int").count() == 0
    with pytest.raises(ValueError):
        cat.read_ranked(spark, cat.largest_first(none), "source_rank")


def test_first_existing(spark, tmp_path):
    _put(tmp_path / "b.csv", "x\n")
    _put(tmp_path / "c.csv", "x\n")
    assert cat.first_existing(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv", "c.csv")]) == str(tmp_path / "b.csv")
    assert cat.first_existing(spark, [str(tmp_path / "a.csv")]) is None


def test_snapshots_are_ordered_by_name_and_undated_ones_left_out(spark, tmp_path):
    for name, value in (("Kickstarter_2022-02", 3), ("Kickstarter_2021_11_18T03", 2), ("ks-2021-03-14", 1), ("notes-12345-01", 9), ("x-2021-13", 9)):
        _put(tmp_path / f"{name}.csv", f"id,v\n7,{value}\n")
    src = cat.sources(cat.file_catalogue(spark, [str(tmp_path)]))
    order = cat.snapshot_order(src)
    assert [(r["year"], r["month"], r["ordinal"], r["in_year"]) for r in order.orderBy("ordinal").collect()] == [
        (2021, 3, 1, 1), (2021, 11, 2, 2), (2022, 2, 3, 1)]
    rows = cat.read_ranked(spark, order, "ordinal", "id int, v int")
    assert sorted(tuple(r) for r in rows.select("id", "v", "ordinal").collect()) == [(7, 1, 1), (7, 2, 2), (7, 3, 3)]
    assert [r["v"] for r in ingest.dedup_keep(rows, "id", ["ordinal"], "last").collect()] == [3]
    assert sorted(r["ordinal"] for r in cat.first_snapshots(src, 1).collect()) == [1, 3]
    assert [r["month"] for r in cat.first_snapshots(src, 1, [2022]).collect()] == [2]


def test_each_file_is_decoded_by_its_own_encoding(spark, tmp_path):
    _put(tmp_path / "utf.csv", "name,n\nÅsa �,1\n日本,2\n,3\n", "utf-8")
    _put(tmp_path / "lat.csv", "name,n\nJosé,4\nplain,5\n", "latin-1")
    rows = ingest.read_csv_with_fallback(spark, str(tmp_path))
    assert {r["n"]: r["name"] for r in rows.collect()} == {1: "Åsa �", 2: "日本", 3: None, 4: "José", 5: "plain"}


def test_a_dump_that_is_latin_1_throughout_and_a_marked_header(spark, tmp_path):
    _put(tmp_path / "lat" / "a.csv", "größe,n\nÀ,1\n", "latin-1")
    assert [r.asDict()["größe"] for r in ingest.read_csv_with_fallback(spark, str(tmp_path / "lat")).collect()] == ["À"]
    _put(tmp_path / "utf" / "a.csv", "größe,n\nÀ,1\n", "utf-8-sig")
    rows = ingest.read_csv_with_fallback(spark, str(tmp_path / "utf"))
    assert rows.columns[:2] == ["größe", "n"] and [r["größe"] for r in rows.collect()] == ["À"]
