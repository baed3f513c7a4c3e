"""Whole records: rows are much work each, however small their tables are."""

from pyspark.sql import functions as F

from noticeloom.operators import extract
from noticeloom.plans import notices as plans

PARTS = "p_partkey long, p_name string, p_size int"


def _stored(spark, tmp_path, n):
    spark.createDataFrame([(i, "name", 1) for i in range(n)], PARTS).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return plans._records(spark, str(tmp_path))


def test_records_of_a_small_table_are_made_on_all_cores(spark, tmp_path):
    records = extract.build_records(*_stored(spark, tmp_path, 40))
    at = records.select("summary", F.spark_partition_id().alias("at")).collect()
    assert len(at) == 40 and len({r.at for r in at}) > 4


def test_amounts_are_looked_for_once(spark):
    said = str(extract.extract_amount(F.upper(F.col("page")), F.reverse(F.col("doc")))).lower()
    assert said.count("rlike") <= 6  # 77 without


def test_reanalysis_makes_no_whole_record(spark, tmp_path, monkeypatch):
    notices, docs, sections = _stored(spark, tmp_path, 4)
    stored = extract.build_records(notices, docs, sections)
    want = {r.project_no: (r.region, r.target, r.summary) for r in stored.collect()}
    stale = stored.withColumn("region", F.lit("old")).withColumn("summary", F.lit("old"))
    monkeypatch.setattr(extract, "extract_fields", None)  # only whole records have them
    got = {r.project_no: (r.region, r.target, r.summary) for r in extract.reanalyze(stale, docs, sections).collect()}
    assert got == {k: (region or "old", target, summary) for k, (region, target, summary) in want.items()}
