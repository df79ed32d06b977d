import pytest

from touchflow.operators.journey import channel_counts, combine_interactions, to_interactions
from touchflow.schemas import CHANNEL_COLUMNS, CUSTOMER_COLUMNS, INTERACTION_COLUMNS, ddl
from touchflow.session import shared_folder
from touchflow.sources import tables as sources
from touchflow.sources.streams import kafka_stream


def write(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_columns_follow_the_header_not_the_position(spark, tmp_path, rows):
    path = write(tmp_path, "mobile.csv",
                 "in_app_purchase,customer_id,extra,screen_views,interaction_date\n"
                 "true,c1,zzz,7,2024-01-15T10:00:00.123456\n"
                 "false,c2,yyy,not a number,2024-01-16 11:00:00\n")
    table = sources.read_channel(spark, "mobile", path)
    assert table.columns == [*CHANNEL_COLUMNS["mobile"], "channel"]
    got = rows(table, "customer_id", "screen_views", "in_app_purchase", "time_spent", "channel")
    assert got == [("c1", 7, True, None, "mobile"), ("c2", None, False, None, "mobile")]
    assert table.filter("customer_id = 'c1'").first()["interaction_date"].microsecond == 123456


def test_files_with_different_headers_are_refused(spark, tmp_path):
    write(tmp_path, "a.csv", "customer_id,session_id\nc1,s1\n")
    write(tmp_path, "b.csv", "session_id,customer_id\ns2,c2\n")
    with pytest.raises(Exception, match="header|Column"):
        sources.read_channel(spark, "web", str(tmp_path)).collect()


def test_channel_of_an_email_file_is_overwritten(spark, tmp_path):
    path = write(tmp_path, "email.csv", "customer_id,channel\nc1,sms\n")
    assert sources.read_channel(spark, "email", path).first()["channel"] == "email"


def test_a_failing_source_is_left_out_and_an_unknown_channel_refused(spark, tmp_path, caplog):
    path = write(tmp_path, "web.csv", "customer_id\nc1\n")
    configs = {"email": {"path": str(tmp_path / "missing.csv")}, "web": {"path": path},
               "mobile": {}}
    collected = sources.collect_channels(spark, configs)
    assert list(collected) == ["web"] and sorted(collected.left_out) == ["email", "mobile"]
    with pytest.raises(Exception):
        sources.collect_channels(spark, configs, strict=True)
    assert "email" in caplog.text and "mobile" in caplog.text
    with pytest.raises(ValueError, match="sms"):
        sources.collect_channels(spark, {"sms": {"path": path}})
    with pytest.raises(ValueError, match="sms"):
        sources.read_channel(spark, "sms", path)


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_save_and_read_back(spark, fmt, rows):
    table = spark.sql(
        "SELECT 'c1' AS customer_id, 30 AS age, 'F' AS gender, 'EUROPE' AS region, "
        "'b' AS brand_preference, 's' AS customer_segment, 1.5D AS lifetime_value, "
        "'web' AS acquisition_channel, TIMESTAMP '2020-01-01 10:00:00.123456' AS "
        "registration_date, CAST(NULL AS timestamp) AS last_purchase_date, "
        "2 AS total_purchases, 9.25D AS average_order_value")
    path = shared_folder(spark, "test")
    for _ in range(2):  # the second run overwrites
        sources.save_table(table, path, fmt)
    assert rows(sources.read_customers(spark, path, fmt)) == rows(table)
    assert sources.read_customers(spark, path, fmt).columns == list(CUSTOMER_COLUMNS)


def test_appended_log_is_pruned_by_day(spark):
    path = shared_folder(spark, "log")
    day = "SELECT 'c{0}' AS customer_id, TIMESTAMP '2024-01-0{0} 10:00:00' AS timestamp"
    for i in (1, 2):
        sources.append_log(spark.sql(day.format(i)), path)
    log = spark.read.parquet(path)
    assert log.count() == 2
    one = log.filter("log_date = DATE '2024-01-02'")
    assert one.first()["customer_id"] == "c2"
    assert len(one.inputFiles()) == 2  # all files of the relation ...
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan  # ... of which one day is read


def channel_frames(spark):
    frames = {}
    for channel, layout in CHANNEL_COLUMNS.items():
        values = {name: f"CAST(NULL AS {kind})" for name, kind in layout.items()}
        values["customer_id"] = "'c1'"
        frames[channel] = spark.sql("SELECT " + ", ".join(
            f"{value} AS {name}" for name, value in values.items()))
    return frames


def test_channels_of_different_width_combine(spark, rows):
    combined = combine_interactions(channel_frames(spark))
    assert dict(combined.dtypes) == INTERACTION_COLUMNS
    assert rows(combined, "channel", "converted") == [
        ("directmail", None), ("email", None), ("instore", True), ("mobile", None),
        ("web", None)]
    assert {n for _, n in rows(channel_counts(combined))} == {1}


def test_direct_mail_time_is_the_response_or_the_dispatch(spark, rows):
    mail = spark.createDataFrame(
        [("a", "2024-01-01", "2024-01-05"), ("b", "2024-01-02", None)],
        "customer_id string, sent string, response string").selectExpr(
        "customer_id", "'k' AS campaign_id", "'m' AS mail_type",
        "CAST(sent AS timestamp) AS sent_date", "CAST(response AS timestamp) AS response_date",
        "true AS responded", "false AS offer_redeemed")
    got = to_interactions(mail, "directmail").selectExpr("customer_id", "day(interaction_ts)")
    assert rows(got) == [("a", 5), ("b", 2)]


def test_combining_nothing_is_an_error():
    with pytest.raises(ValueError):
        combine_interactions({})


def test_kafka_source_needs_its_package(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        kafka_stream(spark, "localhost:1", "events")


def test_ddl_quotes_names():
    assert ddl({"a": "int", "b c": "string"}) == "`a` int, `b c` string"


def test_a_log_gets_few_files_per_day(spark, tmp_path):
    from datetime import datetime

    rows = spark.range(4000).selectExpr(
        "id", "timestamp_seconds(1704067200 + id * 86400 % (86400 * 10)) AS timestamp") \
        .repartition(16)
    path = tmp_path / "log"
    sources.append_log(rows, str(path))
    days = [d for d in path.iterdir() if d.name.startswith("log_date=")]
    assert len(days) == 10
    assert sum(len(list(d.glob("*.parquet"))) for d in days) <= 20
    assert spark.read.parquet(str(path)).count() == 4000
    assert spark.read.parquet(str(path)).agg({"timestamp": "min"}).first()[0] >= datetime(2024, 1, 1)


def test_a_repeated_batch_adds_nothing_to_a_log(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(100).selectExpr("id", "timestamp_seconds(id * 3600) AS timestamp")
    for batch in ("a", "a", "b"):
        sources.append_log(rows, path, batch_id=batch)
    log = spark.read.parquet(path)
    assert log.count() == 200 and log.filter("batch_id = 'a'").count() == 100


def test_rows_that_do_not_parse_are_rejected_with_file_and_reason(spark, tmp_path):
    write(tmp_path, "a.csv", "session_id,page_views,visit_date,customer_id\n"
          "s1,7,2024-01-15T10:00:00,c1\ns2,many,2024-01-15T10:00:00,c2\ns3,many,someday,c3\n"
          "s4,,,\n")
    write(tmp_path, "b.csv", "session_id,page_views,visit_date,customer_id\n"
          "s5,1\ns6,1,2024-01-15T10:00:00,c6,more\n\"s7, x\",2,2024-01-16T10:00:00,c7\n")
    fit, rejects = sources.read_csv_checked(spark, str(tmp_path), CHANNEL_COLUMNS["web"])
    assert fit.columns == list(CHANNEL_COLUMNS["web"])
    assert sorted(r["session_id"] for r in fit.collect()) == ["s1", "s4", "s7, x"]
    assert sorted((r["file"][-5:], r["record"][:2], r["reason"]) for r in rejects.collect()) == [
        ("a.csv", "s2", "page_views"), ("a.csv", "s3", "page_views, visit_date"),
        ("b.csv", "s5", "number of fields"), ("b.csv", "s6", "number of fields")]
    assert "s2,many,2024-01-15T10:00:00,c2" in [r["record"] for r in rejects.collect()]


def test_a_file_without_rows_has_no_rejects(spark, tmp_path):
    path = write(tmp_path, "a.csv", "session_id,page_views\n")
    fit, rejects = sources.read_csv_checked(spark, path, CHANNEL_COLUMNS["web"])
    assert fit.count() == rejects.count() == 0
