"""Queries whose rows must not become fewer than their job has."""

from pyspark.sql import functions as F
from paths import SF

import __spark_entry__ as entry_point
from folioscope.plans import tables


def test_sibling_files_has_each_page_and_all_links(spark, tmp_path):
    urls = [f"http://a.example/x/{k % 40}.html?q={k}" for k in range(90)] + ["http://a.example/y/1", "http://a.example/x/1.html", None, None]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = entry_point.queries()["sibling_files"](spark, str(tmp_path)).collect()
    assert sorted(r["page_id"] for r in got) == list(range(len(urls)))
    folder = [u and u.rsplit("/", 1)[0] + "/" for u in urls]
    assert all(r["siblings"] == folder.count(folder[r["page_id"]]) - 1 and r["dir"] == folder[r["page_id"]] for r in got)
    parts = {}
    for r in got:
        parts.setdefault((r["dir"], r["part"]), []).append(r["page_id"])
    assert max(map(len, parts.values())) == 32


def test_sibling_files_has_each_pair_of_a_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "SIDE_BY_SIDE", 8)
    urls = [f"http://a.example/x/{k % 40}.html?q=/{k}/" for k in range(90)] + ["http://a.example/y/1", "http://b.example", "", None, None]
    spark.createDataFrame([(7 * k - 300, u) for k, u in enumerate(urls)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = entry_point.queries()["sibling_files"](spark, str(tmp_path)).collect()
    folder = {7 * k - 300: u if u is None else u.split("?")[0].rpartition("/")[0] for k, u in enumerate(urls)}
    pairs = sorted((r["page_id"], int(s)) for r in got for s in r["sibling_ids"].split(",") if s)
    assert pairs == sorted((a, b) for a in folder for b in folder if a != b and folder[a] == folder[b])
    assert len(got) == len(urls) and all(r["siblings"] == len([s for s in r["sibling_ids"].split(",") if s]) for r in got)


def test_container_parts_counts_each_annotation(spark):
    noted = spark.read.parquet(f"{SF}/labels.parquet").where("quality is not null").join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").count()
    got = entry_point.queries()["container_parts"](spark, SF).select(F.sum("parts").alias("n"), F.count("*").alias("files")).first()
    assert noted + 8 * got["files"] <= got["n"] <= noted + 10 * got["files"]


def test_container_topic_by_number_has_whole_texts(spark):
    got = entry_point.queries()["container_topic_by_number"](spark, SF)
    assert got.where("length(text) > 44").count() > got.count() // 2


def test_nested_export_shuffles_no_raw_bytes(spark):
    plan = entry_point.queries()["nested_export"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("\n", plan.index("Aggregate")) :]  # what is shuffled to the last grouping
    assert "p_name" in below and "encode" not in below
