"""Log-line parsing, message signatures, categories and likely causes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultlens.functions.text import ASCII_BOUNDARY, contains_any, trim, truncate_bytes

# Levels that count as problems and the three line formats.
ERROR_LEVELS = ("EMERGENCY", "ALERT", "CRITICAL", "ERROR", "FATAL", "EXCEPTION", "WARNING")
DASHED_LINE = (
    r"^(?i)(ERROR|CRITICAL|WARNING|DEBUG|INFO|NOTICE|ALL)\s*-\s*"
    r"([0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9:]+)\s*-->\s*(.*)$"
)
BRACKETED_LINE = (
    r"^\[([0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9:.+-]+)\]\s+[\w.\-]+\."
    r"(?i:(ERROR|CRITICAL|WARNING|ALERT|EMERGENCY|NOTICE|INFO|DEBUG)):\s*(.*)$"
)
LEVEL_WORD = r"(?i)\b(EMERGENCY|ALERT|CRITICAL|FATAL|ERROR|WARNING|EXCEPTION)\b"

# Substrings that name a category, first matching list wins.
CATEGORY_WORDS = {
    "Database": (
        "sqlstate", "mysqli", "mysql", "deadlock", "lock wait", "pdo", "doctrine",
        "query", "database", "too many connections", "sql syntax", "2002", "1205", "1213",
    ),
    "API": (
        "curl", "guzzle", "http error", "http request", "upstream", "gateway",
        "502", "503", "504", "ssl", "connection timed out", "api ",
    ),
    "Auth": (
        "unauthorized", "forbidden", "permission denied", "auth", "token", "csrf", "login failed",
    ),
    "Resource": (
        "allowed memory size", "maximum execution time", "out of memory", "disk",
        "too many open files",
    ),
}

# Texts of the likely causes, in order of precedence.
CAUSES = {
    "deadlock": "Concurrent transactions deadlocking; review locking order and transaction scope.",
    "lock_wait": "Lock wait timeout from long-running transactions; shorten transactions, add indexes.",
    "connections": "Database connection pool exhausted; tune pool size and close connections.",
    "unreachable": "Database unreachable; check host/port/credentials and that the DB is running.",
    "slow_query": "Slow query timing out; add indexes / optimize the query.",
    "memory": "Excessive memory use; stream/paginate data or raise memory_limit.",
    "run_time": "Long-running request; optimize or move work to a background job.",
    "upstream": "Upstream/API latency or downtime; add timeouts, retries, and a circuit breaker.",
}

_D, _B = "(?d)" + DASHED_LINE, "(?d)" + BRACKETED_LINE
_G = "(?d)" + LEVEL_WORD.replace(r"\b", ASCII_BOUNDARY)


def parse_line(line: Column) -> Column:
    """Struct ``(level, ts, message)`` of one trimmed line; null when no level is found."""
    return (
        F.when(
            line.rlike(_D),
            F.struct(
                F.upper(F.regexp_extract(line, _D, 1)).alias("level"),
                F.regexp_extract(line, _D, 2).alias("ts"),
                trim(F.regexp_extract(line, _D, 3)).alias("message"),
            ),
        )
        .when(
            line.rlike(_B),
            F.struct(
                F.upper(F.regexp_extract(line, _B, 2)).alias("level"),
                F.regexp_extract(line, _B, 1).alias("ts"),
                trim(F.regexp_extract(line, _B, 3)).alias("message"),
            ),
        )
        .when(
            line.rlike(_G),
            F.struct(
                F.upper(F.regexp_extract(line, _G, 1)).alias("level"),
                F.lit("").alias("ts"),
                line.alias("message"),
            ),
        )
    )


def level_rank(level: Column) -> Column:
    return (
        F.when(level.isin("EMERGENCY", "ALERT", "CRITICAL", "FATAL"), 4)
        .when(level.isin("ERROR", "EXCEPTION"), 3)
        .when(level == "WARNING", 2)
        .otherwise(1)
    )


def signature(message: Column) -> Column:
    """Grouping key: quoted text, numbers and hex words replaced, blanks collapsed."""
    s = F.regexp_replace(message, "'[^']*'|\"[^\"]*\"", "?")
    s = F.regexp_replace(
        s, ASCII_BOUNDARY + r"[0-9a-fA-Fx]*[0-9][0-9a-fA-Fx]*" + ASCII_BOUNDARY, "#"
    )
    s = F.regexp_replace(s, r"[\t\n\f\r ]+", " ")
    return F.lower(trim(s))


def sample(message: Column) -> Column:
    return truncate_bytes(message, 200)


def category(message: Column) -> Column:
    low = F.lower(message)
    expr = None
    for name, words in CATEGORY_WORDS.items():
        hit = contains_any(low, words)
        expr = F.when(hit, name) if expr is None else expr.when(hit, name)
    return expr.otherwise("Application")


def cause(message: Column) -> Column:
    low = F.lower(message)
    return (
        F.when(low.contains("deadlock"), CAUSES["deadlock"])
        .when(contains_any(low, ("lock wait", "1205")), CAUSES["lock_wait"])
        .when(low.contains("too many connections"), CAUSES["connections"])
        .when(contains_any(low, ("2002", "connection refused")), CAUSES["unreachable"])
        .when(low.contains("timeout") & contains_any(low, ("query", "sql")), CAUSES["slow_query"])
        .when(contains_any(low, ("allowed memory size", "out of memory")), CAUSES["memory"])
        .when(low.contains("maximum execution time"), CAUSES["run_time"])
        .when(contains_any(low, ("curl", "504", "connection timed out")), CAUSES["upstream"])
        .otherwise("")
    )
