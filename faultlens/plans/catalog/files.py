"""Inventory and path queries, file filters and the whole scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.functions import paths
from faultlens.operators import codelines, configscan, inventory
from faultlens.plans import corpora, project_scan
from faultlens.plans.catalog import register
from faultlens.plans.corpora_sql import (
    BENIGN, KIND, MINIFIED, ROLE, SOURCE, basename, case_table, define, extension, in_ignored, in_vendored, kinds_of, sql, text,
)
from faultlens.session import scratch_dir
from faultlens.sources import tree


def listed(spark: SparkSession, d: str) -> DataFrame:
    return corpora.file_paths(spark, d)


def _per_project(condition):
    """Files per project and how many of them satisfy a path predicate."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        return listed(spark, d).groupBy("project").agg(
            F.count("*").alias("files"), F.count_if(condition(F.col("path"))).alias("matching")
        )

    return query


def _per_project_sql(condition: str) -> str:
    return sql(
        f"SELECT project, count(*) AS files, count(*) FILTER ({condition}) AS matching FROM file_paths GROUP BY project",
        "file_paths",
    )


for name, column, condition in (
    ("f_1_ignored_directory", paths.in_ignored_dir, in_ignored("path")),
    ("f_2_vendored_directory", paths.in_vendored_dir, in_vendored("path")),
    ("f_4_minified", paths.is_minified, MINIFIED),
    ("f_5_source_extension", paths.is_source, SOURCE),
    ("f_11_benign_secret_path", paths.benign_secret_path, BENIGN),
):
    register(name, _per_project(column), _per_project_sql(condition))

register(
    "f_3_framework_core",
    lambda spark, d: codelines.analysed_paths(corpora.source_files(spark, d))
    .groupBy("project")
    .agg(F.count("*").alias("files"), F.sum("size").alias("bytes")),
    sql(
        "SELECT project, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM analysed_files GROUP BY project",
        "analysed_files",
    ),
)


def dropped_core_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that only the framework-core rule removes."""
    files = corpora.source_files(spark, d).select("project", "path")
    kept = codelines.without_framework_core(files)
    return files.join(kept, ["project", "path"], "left_anti")


register(
    "j_6_framework_core_prefix",
    dropped_core_files,
    sql(
        """SELECT project, path FROM source_files f
        WHERE EXISTS (SELECT 1 FROM core_dirs d WHERE d.project = f.project AND starts_with(f.path, d.core_dir || '/'))""",
        "source_files", "core_dirs",
    ),
)
register(
    "x_1_path_role",
    lambda spark, d: listed(spark, d).select("project", "path", paths.role(F.col("path")).alias("role")),
    sql(f"SELECT project, path, {ROLE} AS role FROM file_paths", "file_paths"),
)
register(
    "x_6_config_kind",
    lambda spark, d: corpora.config_files(spark, d).select(
        "path", paths.config_kind(F.col("path"), F.col("content")).alias("kind")
    ),
    sql(f"SELECT path, {KIND} AS kind FROM (SELECT *, lower({basename('path')}) AS base FROM config_corpus)", "config_corpus"),
)
define(
    "project_dirs",
    """
SELECT DISTINCT project, array_to_string(parts[1:n], '/') AS dir
FROM (SELECT project, parts, unnest(generate_series(1, len(parts) - 1)) AS n FROM (SELECT project, string_split(path, '/') AS parts FROM walked_paths))
""",
    "walked_paths",
)
register(
    "a_1_file_and_dir_counts",
    lambda spark, d: inventory.totals(listed(spark, d)),
    sql(
        """SELECT project, files, coalesce(dirs, 0) AS dirs FROM (SELECT project, count(*) AS files FROM walked_paths GROUP BY project)
        LEFT JOIN (SELECT project, count(*) AS dirs FROM project_dirs GROUP BY project) USING (project)""",
        "walked_paths", "project_dirs",
    ),
)
define("extensions", f"SELECT project, {extension('path')} AS ext, {basename('path')} AS name FROM walked_paths", "walked_paths")
register(
    "a_2_extension_tally",
    lambda spark, d: inventory.by_extension(listed(spark, d)),
    sql("SELECT project, ext, count(*) AS n FROM extensions WHERE ext <> '' GROUP BY ALL", "extensions"),
)
register(
    "o_8_top_extensions",
    lambda spark, d: inventory.top_extensions(listed(spark, d)).select("project", "position", "ext", "n"),
    sql(
        """SELECT project, CAST(row_number() OVER (PARTITION BY project ORDER BY n DESC, ext) AS INTEGER) AS position, ext, n
        FROM (SELECT project, ext, count(*) AS n FROM extensions WHERE ext <> '' GROUP BY ALL) QUALIFY position <= 10""",
        "extensions",
    ),
)
register(
    "a_3_role_tally",
    lambda spark, d: inventory.by_role(listed(spark, d)),
    sql(
        f"SELECT project, role, count(*) AS n FROM (SELECT project, {ROLE} AS role FROM walked_paths) WHERE role IS NOT NULL GROUP BY ALL",
        "walked_paths",
    ),
)


def manifest_listing(spark: SparkSession, d: str) -> DataFrame:
    return corpora.manifest_files(spark, d).select("project", "path", "is_dir")


define(
    "manifest_names",
    f"""SELECT project, path, {basename('path')} AS name, {extension('path')} AS ext FROM manifest_files WHERE NOT {in_ignored('path')}""",
    "manifest_files",
)
_LABEL = case_table("name", paths.MARKERS, "NULL")
register(
    "a_4_marker_set",
    lambda spark, d: inventory.markers(manifest_listing(spark, d)).withColumn("markers", F.array_join("markers", ", ")),
    sql(
        f"""SELECT project, array_to_string(list_sort(list(DISTINCT label)), ', ') AS markers
        FROM (SELECT project, {_LABEL} AS label FROM manifest_names) WHERE label IS NOT NULL GROUP BY project""",
        "manifest_names",
    ),
)
define(
    "all_names",
    "SELECT project, name, ext FROM manifest_names UNION ALL SELECT project, name, ext FROM extensions",
    "manifest_names", "extensions",
)
register(
    "a_5_dominant_language",
    lambda spark, d: inventory.dominant_language(
        manifest_listing(spark, d).unionByName(listed(spark, d).select("project", "path", "is_dir"))
    ),
    sql(
        f"""SELECT project, coalesce(arg_min(lang, struct_pack(b := -b, n := -n, l := lang)), 'Unknown') AS language FROM (
          SELECT p.project, c.lang, c.n, c.b FROM (SELECT DISTINCT project FROM all_names) p LEFT JOIN (
            SELECT project, lang, sum(n) AS n, max(b) AS b FROM (
              SELECT project, {case_table('ext', paths.EXT_LANGUAGE, 'NULL')} AS lang, 1 AS n, 0 AS b FROM all_names
              UNION ALL SELECT project, {case_table('name', paths.BACKEND_LANGUAGE, 'NULL')}, 0, 1 FROM all_names)
            WHERE lang IS NOT NULL GROUP BY ALL HAVING sum(n) > 0) c USING (project))
        GROUP BY project""",
        "all_names",
    ),
)


def every_file(spark: SparkSession, d: str) -> DataFrame:
    """Source, config and manifest corpora as one files table."""
    columns = ["project", "path", "is_dir", "size", "content"]
    return (
        corpora.source_files(spark, d).select(*columns)
        .unionByName(corpora.config_files(spark, d).select(*columns))
        .unionByName(corpora.manifest_files(spark, d).select(*columns))
    )


define(
    "every_file",
    """SELECT project, path, size, content FROM source_files UNION ALL SELECT project, path, size, content FROM config_corpus
    UNION ALL SELECT project, path, size, content FROM manifest_files""",
    "source_files", "config_corpus", "manifest_files",
)
define(
    "every_core_dir",
    r"""SELECT DISTINCT project, left(path, length(path) - length('/core/CodeIgniter.php')) AS core_dir
    FROM every_file WHERE regexp_matches(path, '(^|/)(?i:system)/core/CodeIgniter\.php$')""",
    "every_file",
)
define(
    "every_analysed",
    f"""SELECT * FROM every_file f WHERE NOT {in_vendored('path')}
    AND NOT EXISTS (SELECT 1 FROM every_core_dir d WHERE d.project = f.project AND starts_with(f.path, d.core_dir || '/'))""",
    "every_file", "every_core_dir",
)
define("every_config", kinds_of("every_analysed"), "every_analysed")
register(
    "a_7_files_scanned",
    lambda spark, d: project_scan.files_scanned(every_file(spark, d)),
    sql(
        f"""SELECT project, CAST(sum(n) AS BIGINT) AS files_scanned FROM (
          SELECT DISTINCT project, 0 AS n FROM every_file
          UNION ALL SELECT project, 1 FROM every_analysed WHERE NOT {MINIFIED} AND {SOURCE} AND {basename('path')} NOT IN ({', '.join(text(m) for m in paths.DEPENDENCY_MANIFESTS)})
          UNION ALL SELECT project, 1 FROM every_config) GROUP BY project""",
        "every_file", "every_analysed", "every_config",
    ),
)


register(
    "a_7_config_files_by_kind",
    lambda spark, d: configscan.config_files(corpora.config_files(spark, d)).groupBy("project", "kind").agg(F.count("*").alias("n")),
    sql("SELECT project, kind, count(*) AS n FROM config_kinds GROUP BY ALL", "config_kinds"),
)


register(
    "s_1_tree_rows",
    lambda spark, d: tree.tree_rows(every_file(spark, d))
    .groupBy("project", "is_dir", "in_core")
    .agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.sum(F.length("path")).alias("letters")),
    sql(
        f"""SELECT e.project, is_dir, EXISTS (SELECT 1 FROM every_core_dir d
            WHERE d.project = e.project AND starts_with(e.path || '/', d.core_dir || '/') AND NOT {in_ignored("d.core_dir || '/x'")}) AS in_core,
          count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(length(path)) AS BIGINT) AS letters
        FROM (
          SELECT project, path, false AS is_dir, size FROM every_file WHERE NOT {in_ignored('path')}
          UNION ALL
          SELECT DISTINCT project, path, true, 0 FROM (
            SELECT project, array_to_string(parts[1:unnest(range(1, len(parts)))], '/') AS path
            FROM (SELECT DISTINCT project, string_split(path, '/') AS parts FROM every_file))
          WHERE NOT {in_ignored("path || '/x'")}) e GROUP BY ALL""",
        "every_file", "every_core_dir",
    ),
)


def walked(spark: SparkSession, d: str) -> DataFrame:
    """The trees of all projects, written as directories and walked again, a batch of them at a time."""
    entries = tree.written_and_walked(every_file(spark, d), scratch_dir(spark, "trees")).where(F.contains("path", F.lit("/")))
    project = F.substring_index("path", "/", 1)
    below = F.expr("substring(path, length(substring_index(path, '/', 1)) + 2)")
    return entries.select(project.alias("project"), below.alias("path"), "is_dir", "size", "in_core")


register(
    "s_1_tree_walk",
    walked,
    sql(
        f"""SELECT e.project, path, is_dir, size, EXISTS (SELECT 1 FROM every_core_dir d
            WHERE d.project = e.project AND starts_with(e.path || '/', d.core_dir || '/') AND NOT {in_ignored("d.core_dir || '/x'")}) AS in_core
        FROM (
          SELECT project, path, false AS is_dir, CAST(octet_length(encode(content)) AS BIGINT) AS size FROM every_file WHERE NOT {in_ignored('path')}
          UNION ALL
          SELECT DISTINCT project, path, true, 0 FROM (
            SELECT project, array_to_string(parts[1:unnest(range(1, len(parts)))], '/') AS path
            FROM (SELECT DISTINCT project, string_split(path, '/') AS parts FROM every_file))
          WHERE NOT {in_ignored("path || '/x'")}) e""",
        "every_file", "every_core_dir",
    ),
)
