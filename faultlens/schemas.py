"""Row schemas of the data model."""

from pyspark.sql import types as T

FILES = T.StructType(
    [
        T.StructField("project", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("is_dir", T.BooleanType()),
        T.StructField("size", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField("in_core", T.BooleanType()),
    ]
)

FINDINGS = T.StructType(
    [
        T.StructField("project", T.StringType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("snippet", T.StringType()),
        T.StructField("explanation", T.StringType()),
        T.StructField("recommendation", T.StringType()),
        T.StructField("cwe", T.StringType()),
        T.StructField("owasp", T.StringType()),
        T.StructField("phase", T.IntegerType()),
        T.StructField("ord", T.IntegerType()),
    ]
)
#: Findings also carry ``identity``: a hash of the whole snippet (or of the whole title, without
#: a snippet) where the shown one is cut, else null. Given tables need not have it.
FINDING_COLUMNS = [*[f.name for f in FINDINGS.fields], "identity"]

RUNTIME_EVENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("timestamp", "type", "message", "file")]
    + [T.StructField("line", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("trace", "url", "method", "user", "severity", "app")]
)

SCAN_RECORD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("project", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("stack", T.ArrayType(T.StringType())),
        T.StructField("total", T.LongType()),
        T.StructField("critical", T.LongType()),
        T.StructField("high", T.LongType()),
        T.StructField("medium", T.LongType()),
        T.StructField("low", T.LongType()),
        T.StructField("new_since", T.LongType()),
        T.StructField("files_scanned", T.LongType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("security_score", T.IntegerType()),
        T.StructField("security_grade", T.StringType()),
        T.StructField("health_score", T.IntegerType()),
        T.StructField("health_grade", T.StringType()),
    ]
)
