"""Files of many headers, and how often a row is parsed."""

from tidecast.sources import intake


def test_rows_are_parsed_once(spark):
    raw = spark.createDataFrame([("1", "2024-02-03", "5.5"), ("2", "bad", "1"), ("3", "3/2/2024", "n/a")], "Store string, Date string, Sales string")
    valid, rejected, report = intake.validate_frame(raw)
    for df in (valid, rejected, report):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("yyyy-M-d") == 1
    assert [tuple(r)[0] for r in valid.collect()] == ["1"] and {r.store: r.reason for r in rejected.collect()} == {"2": "bad date", "3": "bad sales"}
    assert report.first().records_in == 3


def test_headers_are_found_without_sorting_the_lines(spark, tmp_path):
    """First lines of files of several tasks and batches, of which some are empty; no task sorts what follows them."""
    for i in range(12):
        head = "Date,Sales,Store" if i % 3 else "store_id,sales,date"
        (tmp_path / f"f{i:02}.csv").write_text(head + "\n" + "2024-01-02,1.5,a\n" * (30 * i) if i != 5 else "")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = intake.files_by_header(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert {k: sorted(int(f[-6:-4]) for f in v) for k, v in found.items()} == {"Date,Sales,Store": [1, 2, 4, 7, 8, 10, 11], "store_id,sales,date": [0, 3, 6, 9]}
    lines = spark.read.text(str(tmp_path)).selectExpr("_metadata.file_path AS file", "value AS header")
    plan = lines.mapInArrow(intake.first_lines, "file string, header string").groupBy("header").count()._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
