import pytest
from pyspark.sql import functions as F

from faultlens.operators import errorgroups, loggroups, windows
from faultlens.sources import events, logs
from faultlens.streaming import live

LOG = """ERROR - 2026-06-19 09:01:00 --> Query error: SQLSTATE[HY000] [2002] Connection refused (host 10.0.0.1:3306)
ERROR - 2026-06-19 09:02:00 --> Query error: SQLSTATE[HY000] [2002] Connection refused (host 10.0.0.2:3306)

INFO - 2026-06-19 09:02:10 --> started
[2026-06-19 09:04:30] production.ERROR: Query error: SQLSTATE[HY000] [2002] Connection refused (host 10.0.0.7:3306)
DEBUG - 2026-06-19 09:02:20 --> cache warm
WARNING - 2026-06-19 09:05:00 --> Deadlock found when trying to get lock 'a1'
CRITICAL - 2026-06-19 09:04:00 --> Deadlock found when trying to get lock 'b2'
PHP Fatal error: payment gateway timeout after 30s
plain line
"""


def event(ts, kind, file, line, message, severity="error"):
    return (
        f'{{"timestamp": "{ts}", "type": "{kind}", "message": "{message}", "file": "{file}", '
        f'"line": {line}, "severity": "{severity}"}}'
    )


EVENTS = [
    event("2026-06-19T09:01:00", "DatabaseException", "m.php", 120, "first"),
    event("2026-06-19T09:03:00", "DatabaseException", "m.php", 120, "tie early"),
    event("2026-06-19T09:03:00", "DatabaseException", "m.php", 120, "tie late"),
    "broken {",
    '{"type": "E_ERROR", "line": "1"}',
    '{"type": 7, "line": 1}',
    event("2026-06-19T09:02:00", "E_ERROR", "r.php", 210, "memory", "fatal"),
    '{"type": "E_ERROR", "app": null}',
    "null",
]


def test_log_groups(spark, tmp_path):
    (tmp_path / "a.log").write_text(LOG)
    (tmp_path / "skip.csv").write_text("ERROR - 2026-06-19 09:01:00 --> no\n")
    lines = logs.read_logs(spark, str(tmp_path))
    totals = loggroups.log_totals(lines).first()
    assert (totals.files_parsed, totals.total_lines, totals.total_errors) == (1, 9, 6)
    groups = loggroups.log_groups(lines).orderBy(*loggroups.group_order()).collect()
    assert [g["count"] for g in groups] == [3, 2, 1]
    top, deadlock, gateway = groups
    assert top.signature == "query error: sqlstate[hy000] [#] connection refused (host #.#.#.#:#)"
    assert (top.first_seen, top.last_seen) == ("2026-06-19 09:01:00", "2026-06-19 09:04:30")
    assert top.category == "Database" and top.cause
    assert deadlock.level == "CRITICAL" and "'a1'" in deadlock["sample"]
    assert (gateway.category, gateway.cause, gateway.first_seen) == ("API", "", "")
    with pytest.raises(FileNotFoundError):
        logs.read_logs(spark, str(tmp_path / "missing"))


def test_line_order_over_files_and_splits(spark, tmp_path):
    """The first line of a signature is the first in file order, whatever the splits."""
    for name, start in (("b.log", 1000), ("a.log", 0)):
        body = "".join(f"ERROR - 2026-01-01 00:00:00 --> same 'v{start + i}'\n" for i in range(900))
        (tmp_path / name).write_text(body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        groups = loggroups.log_groups(logs.read_logs(spark, str(tmp_path))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(g["count"], g["sample"]) for g in groups] == [(1800, "same 'v0'")]


def test_runtime_groups(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text("\n".join(EVENTS) + "\n")
    loaded = events.read_events(spark, str(tmp_path))
    groups = errorgroups.runtime_groups(loaded).orderBy(*errorgroups.group_order()).collect()
    assert sum(g["count"] for g in groups) == 6
    top = groups[0]
    assert (top.type, top.line, top["count"], top.last_message) == ("DatabaseException", 120, 3, "tie late")
    recent = errorgroups.recent_events(loaded, 2).collect()
    assert [r.message for r in recent] == ["tie early", "tie late"]


GROUPS = "type string, file string, line long, count long, last_seen string, last_message string, severity string"


def test_kept_groups_equal_batch_over_batches_failure_and_restart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    calls = []

    def merge(groups):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return live.merged_runtime_groups(groups)

    def run():
        stream = spark.readStream.option("maxFilesPerTrigger", "1").text(str(tmp_path / "in"))
        keys = ["type", "file", "line"]
        query = live.maintain(stream, live.runtime_groups, merge, keys, str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination()

    (tmp_path / "in" / "e1.txt").write_text("\n".join(EVENTS[:3]) + "\n")
    (tmp_path / "in" / "e2.txt").write_text("\n".join(EVENTS[3:5]) + "\n")
    run()
    (tmp_path / "in" / "e3.txt").write_text("\n".join(EVENTS[5:]) + "\n")
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    got = live.kept(spark, str(tmp_path / "out"), GROUPS)
    want = errorgroups.runtime_groups(events.read_events(spark, str(tmp_path / "in"), ("*.txt",)))
    columns = ["type", "file", "line", "count", "last_seen", "last_message", "severity"]
    assert len(calls) == 4
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    # What is read is one folder for each bucket, not one for each batch.
    assert len(got.inputFiles()) <= got.count()


def test_nothing_kept_yet(spark, tmp_path):
    assert live.kept(spark, str(tmp_path / "none"), GROUPS).collect() == []


def test_late_lines_are_dropped_and_counted(spark, tmp_path):
    schema = "value string, at timestamp"

    def run(rows):
        data = spark.createDataFrame(rows, "value string, at string").select("value", F.col("at").cast("timestamp").alias("at"))
        data.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        rate = live.error_rate(stream, F.col("at"), "1 hour", "10 minutes")
        query = live.start(rate, str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination()
        return live.dropped_late(query)

    line = "ERROR - 2026-06-19 09:01:00 --> query failed"
    assert run([(line, "2026-06-19 09:01:00"), (line, "2026-06-19 09:59:00"), (line, "2026-06-19 11:30:00")]) == 0
    assert run([(line, "2026-06-19 09:30:00"), (line, "2026-06-19 11:05:00"), (line, "2026-06-19 13:30:00")]) == 1
    got = {(r.window_start.hour, r["count"]) for r in live.finished(spark, str(tmp_path / "out")).collect()}
    assert got == {(9, 2), (11, 2)}


def test_event_lines_beyond_32_bits(spark):
    lines = spark.createDataFrame([('{"type": "E", "line": 5000000000}',)], "value string")
    assert events.parse_events(lines).first().line == 5_000_000_000


def test_large_limits_per_key_are_cut_in_buckets(spark):
    rows = spark.range(20_000).selectExpr("'p' AS project", "id")
    top = windows.first_n(rows, ["project"], [F.col("id").desc()], 2000)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window ") >= 2
    # The plan reads upwards: a limit stands below the first shuffle, so that map tasks apply it.
    assert "WindowGroupLimit" in plan[plan.rindex("Exchange") :]
    assert sorted(r.id for r in top.collect()) == list(range(18_000, 20_000))
