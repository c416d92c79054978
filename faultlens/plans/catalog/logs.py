"""Log and runtime-event queries, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultlens.functions import logtext, severity
from faultlens.operators import errorgroups, loggroups
from faultlens.plans import corpora
from faultlens.plans.catalog import register
from faultlens.plans.corpora_sql import case_table, runtime_groups, sql
from faultlens.session import scratch_dir
from faultlens.sources import events as event_source
from faultlens.sources import logs as log_source
from faultlens.sources import tree
from faultlens.streaming import live


def _lines(spark, d):
    return corpora.log_lines(spark, d)


def _events(spark, d):
    return event_source.parse_events(corpora.runtime_json(spark, d))


# --- sources ------------------------------------------------------------------


#: Lines of a project that make one log file of the corpus.
LINES_PER_FILE = 1000


def log_source_lines(spark: SparkSession, d: str) -> DataFrame:
    """The log corpus written as files for all three globs and read back, line by line."""
    base = scratch_dir(spark, "logs")
    name = F.concat_ws("-", "project", F.col("part").cast("string"))
    path = (
        F.when(F.col("part") % 3 == 0, F.concat(name, F.lit(".log")))
        .when(F.col("part") % 3 == 1, F.concat(name, F.lit(".txt")))
        .otherwise(F.concat(F.lit("log-"), name, F.lit(".php")))
    )
    lines = _lines(spark, d).withColumn("part", F.floor(F.col("line_order") / LINES_PER_FILE))
    files = lines.groupBy("project", "part").agg(F.sort_array(F.collect_list(F.struct("line_order", "value"))).alias("lines"))
    tree.write_trees(files.select(F.lit("app").alias("project"), path.alias("path"), F.array_join("lines.value", "\n").alias("content")), base)
    place = F.row_number().over(Window.partitionBy("source_file").orderBy("line_order"))
    return log_source.read_logs(spark, f"{base}/app").select(
        F.substring_index("source_file", "/", -1).alias("file"), F.col("line_order.glob").alias("glob"), place.alias("place"), "value"
    )


register(
    "s_4_log_source",
    log_source_lines,
    sql(
        f"""SELECT CASE part % 3 WHEN 0 THEN name || '.log' WHEN 1 THEN name || '.txt' ELSE 'log-' || name || '.php' END AS file,
          CAST(part % 3 AS INTEGER) AS glob, CAST(row_number() OVER (PARTITION BY name ORDER BY line_order) AS INTEGER) AS place, value
        FROM (SELECT *, line_order // {LINES_PER_FILE} AS part, project || '-' || (line_order // {LINES_PER_FILE}) AS name FROM log_lines)""",
        "log_lines",
    ),
)


def runtime_source_counts(spark: SparkSession, d: str) -> DataFrame:
    """The event corpus written as text files and read back by the event source."""
    path = scratch_dir(spark, "events")
    corpora.runtime_json(spark, d).select("value").write.mode("overwrite").text(path)
    events = event_source.read_events(spark, path, ("*.txt",))
    return events.groupBy("type", "file", "line", "severity").agg(F.count("*").alias("n"))


register(
    "s_5_runtime_source",
    runtime_source_counts,
    sql("SELECT type, file, line, severity, count(*) AS n FROM runtime_events GROUP BY ALL", "runtime_events"),
)

# --- parsing and texts ----------------------------------------------------------

register(
    "f_17_error_levels",
    lambda spark, d: loggroups.parsed_lines(_lines(spark, d))
    .groupBy(
        F.coalesce("level", F.lit("none")).alias("level"),
        F.coalesce(F.col("level").isin(*logtext.ERROR_LEVELS), F.lit(False)).alias("is_error"),
    )
    .agg(F.count("*").alias("n")),
    sql(
        "SELECT coalesce(level, 'none') AS level, coalesce(level IN "
        f"({', '.join(repr(v) for v in logtext.ERROR_LEVELS)}), false) AS is_error, count(*) AS n FROM log_parsed GROUP BY ALL",
        "log_parsed",
    ),
)
register(
    "x_7_log_line_parse",
    lambda spark, d: loggroups.parsed_lines(_lines(spark, d)).select("line_order", "level", "ts", "message"),
    sql("SELECT line_order, level, ts, message FROM log_parsed", "log_parsed"),
)
register(
    "x_8_level_rank",
    lambda spark, d: loggroups.parsed_lines(_lines(spark, d))
    .where(F.col("level").isNotNull())
    .groupBy("level", logtext.level_rank(F.col("level")).alias("level_rank"))
    .agg(F.count("*").alias("n")),
    sql(
        """SELECT level, CASE WHEN level IN ('EMERGENCY','ALERT','CRITICAL','FATAL') THEN 4
           WHEN level IN ('ERROR','EXCEPTION') THEN 3 WHEN level = 'WARNING' THEN 2 ELSE 1 END AS level_rank,
           count(*) AS n FROM log_parsed WHERE level IS NOT NULL GROUP BY ALL""",
        "log_parsed",
    ),
)
register(
    "x_9_message_signature",
    lambda spark, d: loggroups.error_lines(_lines(spark, d)).select("line_order", "signature"),
    sql("SELECT line_order, signature FROM log_errors", "log_errors"),
)
register(
    "x_10_message_category",
    lambda spark, d: loggroups.error_lines(_lines(spark, d)).select("line_order", "category"),
    sql("SELECT line_order, category FROM log_errors", "log_errors"),
)
register(
    "x_11_likely_cause",
    lambda spark, d: loggroups.error_lines(_lines(spark, d)).select(
        "line_order", logtext.cause(F.col("message")).alias("cause")
    ),
    sql("SELECT line_order, cause FROM log_errors", "log_errors"),
)
register(
    "x_15_severity_maps",
    lambda spark, d: _events(spark, d)
    .select(F.lit("runtime").alias("source"), F.col("severity").alias("word"), severity.from_runtime(F.col("severity")).alias("mapped"))
    .unionByName(
        loggroups.parsed_lines(_lines(spark, d))
        .where(F.col("level").isNotNull())
        .select(F.lit("log").alias("source"), F.col("level").alias("word"), severity.from_log_level(F.col("level")).alias("mapped"))
    )
    .groupBy("source", "word", "mapped")
    .agg(F.count("*").alias("n")),
    sql(
        f"""SELECT 'runtime' AS source, severity AS word, {case_table('severity', {'fatal': 'Critical', 'error': 'High'}, "'Medium'")} AS mapped, count(*) AS n
        FROM runtime_events GROUP BY ALL
        UNION ALL
        SELECT 'log', level, CASE WHEN level IN ('EMERGENCY','ALERT','CRITICAL','FATAL') THEN 'Critical' WHEN level IN ('ERROR','EXCEPTION') THEN 'High'
          WHEN level = 'WARNING' THEN 'Medium' ELSE 'Low' END, count(*) FROM log_parsed WHERE level IS NOT NULL GROUP BY ALL""",
        "runtime_events", "log_parsed",
    ),
)

# --- log groups -------------------------------------------------------------------

_GROUP = "signature, sample, category, level, count, first_seen, last_seen, cause"


def log_groups(spark: SparkSession, d: str) -> DataFrame:
    return loggroups.log_groups(_lines(spark, d))


register("a_15_log_groups", log_groups, sql(f"SELECT {_GROUP} FROM log_groups", "log_groups"))
register(
    "a_15_log_groups_by_project",
    lambda spark, d: loggroups.log_groups(_lines(spark, d), ["project"]),
    sql(f"SELECT project, {_GROUP} FROM log_groups_by_project", "log_groups_by_project"),
)
register(
    "a_14_log_totals",
    lambda spark, d: loggroups.log_totals(_lines(spark, d), ["project"]),
    sql(
        """SELECT project, count(DISTINCT source_file) AS files_parsed, count(*) AS total_lines,
           count(*) FILTER (level IN ('EMERGENCY','ALERT','CRITICAL','ERROR','FATAL','EXCEPTION','WARNING')) AS total_errors
           FROM log_parsed GROUP BY project""",
        "log_parsed",
    ),
)
register(
    "a_14_log_levels",
    lambda spark, d: loggroups.log_levels(_lines(spark, d), ["project"]),
    sql("SELECT project, level, count(*) AS n FROM log_errors GROUP BY ALL", "log_errors"),
)
register(
    "a_14_log_categories",
    lambda spark, d: loggroups.log_categories(_lines(spark, d), ["project"]),
    sql("SELECT project, category, count(*) AS n FROM log_errors GROUP BY ALL", "log_errors"),
)
register(
    "o_2_log_group_order",
    lambda spark, d: log_groups(spark, d).orderBy(*loggroups.group_order()).select("count", "signature"),
    sql("SELECT count, signature FROM log_groups ORDER BY count DESC, signature", "log_groups"),
)
register(
    "o_3_most_common_log_issue",
    lambda spark, d: loggroups.most_common(log_groups(spark, d)).select("count", "level", "category", "sample", "cause"),
    sql(
        "SELECT count, level, category, sample, cause FROM (SELECT * FROM log_groups ORDER BY count DESC, signature LIMIT 11)",
        "log_groups",
    ),
)

# --- runtime groups ---------------------------------------------------------------

_RT = "type, file, line, count, last_seen, last_message, severity"


def runtime_groups_(spark: SparkSession, d: str) -> DataFrame:
    return errorgroups.runtime_groups(_events(spark, d))


register("a_16_runtime_groups", runtime_groups_, sql(f"SELECT {_RT} FROM runtime_groups", "runtime_groups"))
register(
    "a_16_runtime_groups_by_project",
    lambda spark, d: errorgroups.runtime_groups(_events(spark, d), ["project"]),
    sql(runtime_groups("project"), "runtime_events"),
)
register(
    "o_4_runtime_group_order",
    lambda spark, d: runtime_groups_(spark, d).orderBy(*errorgroups.group_order()).select("type", "file", "line", "count", "last_seen"),
    sql(
        """SELECT type, file, line, count, last_seen FROM runtime_groups
           ORDER BY count DESC, last_seen DESC, type, file, line""",
        "runtime_groups",
    ),
)
register(
    "o_5_recent_events",
    lambda spark, d: errorgroups.recent_events(_events(spark, d)).select("event_order", "timestamp", "type", "message"),
    sql(
        "SELECT event_order, timestamp, type, message FROM runtime_events ORDER BY timestamp DESC, event_order LIMIT 15",
        "runtime_events",
    ),
)
register(
    "o_11_console_runtime_groups",
    lambda spark, d: errorgroups.top_groups(runtime_groups_(spark, d)).select(
        "count", "type", errorgroups.place().alias("place")
    ),
    sql(
        """SELECT count, type, CASE WHEN line > 0 THEN file || ':' || line ELSE file END AS place
           FROM (SELECT * FROM runtime_groups ORDER BY count DESC, last_seen DESC, type, file, line LIMIT 10)""",
        "runtime_groups",
    ),
)

# --- streams ----------------------------------------------------------------------


#: The events arrive in three parts; every twentieth comes with the last one, however old.
_PART = "CASE WHEN event_id % 20 = 0 OR day(ts) > 20 THEN 3 WHEN day(ts) > 10 THEN 2 ELSE 1 END"


def _in_parts(spark: SparkSession, d: str, label: str, run) -> str:
    """Run a job three times over a growing folder of events, each time from where it stopped.

    ``run`` gets the stream and the folders of output and state. Returns the former.
    """
    base = scratch_dir(spark, label)
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts", "user_id", "event_type", "props")
    for part in (1, 2, 3):
        events.where(F.expr(_PART) == part).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{base}/in")
        run(corpora.with_event_keys(stream), f"{base}/out", f"{base}/state").awaitTermination()
    return f"{base}/out"


def streamed_runtime_groups(spark: SparkSession, d: str) -> DataFrame:
    def run(events: DataFrame, out: str, state: str):
        lines = corpora.runtime_line_columns(events)
        return live.maintain(lines, live.runtime_groups, live.merged_runtime_groups, ["type", "file", "line"], out, state)

    schema = "type string, file string, line long, count long, last_seen string, last_message string, severity string"
    return live.kept(spark, _in_parts(spark, d, "runtime-stream", run), schema)


register(
    "t_1_runtime_group_stream",
    streamed_runtime_groups,
    sql(
        """SELECT type, file, line, count(*) AS count, max(timestamp) AS last_seen,
             max(CASE WHEN age = 1 THEN message END) AS last_message, max(CASE WHEN age = 1 THEN severity END) AS severity
           FROM (SELECT *, row_number() OVER (PARTITION BY type, file, line ORDER BY timestamp DESC, message DESC) AS age FROM runtime_events)
           GROUP BY type, file, line""",
        "runtime_events",
    ),
)


def streamed_error_rate(spark: SparkSession, d: str) -> DataFrame:
    def run(events: DataFrame, out: str, state: str):
        lines = corpora.log_line_columns(events)
        return live.start(live.error_rate(lines, F.col("ts").cast("timestamp"), "1 day", "10 minutes"), out, state)

    done = live.finished(spark, _in_parts(spark, d, "rate-stream", run))
    return done.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "signature", "count"
    )


register(
    "t_2_error_rate_stream",
    streamed_error_rate,
    sql(
        f"""SELECT strftime(day, '%Y-%m-%d %H:%M') AS window_start, signature, count(*) AS count
           FROM (SELECT signature, date_trunc('day', event_ts) AS day, part, max(event_ts) OVER () AS newest,
                   max(event_ts) FILTER (part < 2) OVER () AS before_2, max(event_ts) FILTER (part < 3) OVER () AS before_3
                 FROM (SELECT signature, event_ts, {_PART.replace("event_id", "line_order").replace("(ts)", "(event_ts)")} AS part FROM log_errors e))
           WHERE day + INTERVAL 1 DAY <= newest - INTERVAL 10 MINUTE
             AND NOT coalesce(part = 2 AND day + INTERVAL 1 DAY <= before_2 - INTERVAL 10 MINUTE, false)
             AND NOT coalesce(part = 3 AND day + INTERVAL 1 DAY <= before_3 - INTERVAL 10 MINUTE, false)
           GROUP BY ALL""",
        "log_errors",
    ),
)


def streamed_log_groups(spark: SparkSession, d: str) -> DataFrame:
    def run(events: DataFrame, out: str, state: str):
        lines = corpora.log_line_columns(events).drop("ts")
        return live.maintain(lines, live.log_groups, live.merged_log_groups, ["signature"], out, state)

    schema = "signature string, count long, level_rank int, first_seen string, last_seen string"
    return live.kept(spark, _in_parts(spark, d, "log-stream", run), schema)


register(
    "t_3_log_group_stream",
    streamed_log_groups,
    sql(
        """SELECT signature, count(*) AS count, max(level_rank) AS level_rank,
             coalesce(min(nullif(ts, '')), '') AS first_seen, coalesce(max(nullif(ts, '')), '') AS last_seen
           FROM log_errors GROUP BY signature""",
        "log_errors",
    ),
)
