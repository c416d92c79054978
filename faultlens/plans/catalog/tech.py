"""Technology detection over the manifest corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.operators import technology
from faultlens.plans import corpora
from faultlens.plans.catalog import register
from faultlens.plans.corpora_sql import basename, contains_any, define, extension, in_ignored, sql, text


def manifest_files(spark: SparkSession, d: str) -> DataFrame:
    return corpora.manifest_files(spark, d)


def tech(spark: SparkSession, d: str) -> DataFrame:
    return technology.technologies(manifest_files(spark, d)).withColumn("evidence", F.array_join("evidence", "; "))


define(
    "first_manifests",
    f"""
SELECT project, name, arg_min(path, string_split(path, '/')) AS path, arg_min(content, string_split(path, '/')) AS content
FROM (SELECT *, {basename('path')} AS name FROM manifest_files WHERE NOT {in_ignored('path')})
WHERE name IN ({', '.join(text(n) for n in technology.INTERESTING)}) GROUP BY project, name
""",
    "manifest_files",
)
register(
    "w_4_first_manifest",
    lambda spark, d: technology.first_manifests(manifest_files(spark, d)).select("project", "name", "path"),
    sql("SELECT project, name, path FROM first_manifests", "first_manifests"),
)


def deep_yaml(spark: SparkSession, d: str) -> DataFrame:
    """YAML paths of whole parts table under few projects, so that the cap bites."""
    files = corpora.config_files(spark, d)
    return files.withColumn("project", F.substring("project", 1, 2)).withColumn(
        "path", F.concat(F.col("path"), F.lit(".yaml"))
    )


register(
    "w_5_scanned_files",
    lambda spark, d: technology.scanned(deep_yaml(spark, d), (".yaml", ".yml")).select("project", "path"),
    sql(
        f"""SELECT left(project, 2) AS project, path || '.yaml' AS path FROM config_corpus WHERE NOT {in_ignored('path')}""",
        "config_corpus",
    ),
)


def _body(name: str) -> str:
    return f"max(CASE WHEN name = {text(name)} THEN content END)"


_COLUMNS = {name: f"m{i}" for i, name in enumerate(technology.INTERESTING)}
define(
    "manifest_bodies",
    "SELECT project, " + ", ".join(f"{_body(n)} AS {c}" for n, c in _COLUMNS.items()) + " FROM first_manifests GROUP BY project",
    "first_manifests",
)
_K8S = "contains(content, 'apiVersion:') AND contains(content, 'kind:') AND (contains(content, 'Deployment') OR contains(content, 'Service') OR contains(content, 'Pod'))"
define(
    "directories",
    f"""
SELECT p.project, coalesce(k8s_dir, false) AS k8s_dir, coalesce(aws_dir, false) AS aws_dir, k8s_file, aws_file
FROM (SELECT DISTINCT project FROM manifest_files) p
LEFT JOIN (SELECT project,
    bool_or(list_has_any(list_transform(string_split(path, '/')[:-2], lambda d: lower(d)), ['k8s', 'kubernetes', 'manifests', 'charts'])) AS k8s_dir,
    bool_or(list_has_any(list_transform(string_split(path, '/')[:-2], lambda d: lower(d)), ['.aws', '.ebextensions'])) AS aws_dir,
    arg_min(path, string_split(path, '/')) FILTER ({extension('path')} IN ('.yaml', '.yml') AND {_K8S}) AS k8s_file,
    arg_min(path, string_split(path, '/')) FILTER ({extension('path')} = '.tf' AND contains(content, 'provider "aws"')) AS aws_file
  FROM manifest_files WHERE NOT {in_ignored('path')} GROUP BY project) USING (project)
""",
    "manifest_files",
)


def _has(name: str) -> str:
    return f"({_COLUMNS[name]} IS NOT NULL)"


def _first(*names: str) -> str:
    """Body of the first manifest that is not empty."""
    return "coalesce(" + ", ".join(f"nullif({_COLUMNS[n]}, '')" for n in names) + ", '')"


def _all(*names: str) -> str:
    return "lower(" + " || ".join(f"coalesce({_COLUMNS[n]}, '')" for n in names) + ")"


def _version(manifest: str, sections: tuple[str, str], package: str) -> str:
    body = _COLUMNS[manifest]
    found = ", ".join(
        f"""CASE WHEN json_valid({body}) THEN json_extract_string({body}, '$."{s}"."{package}"') END""" for s in sections
    )
    return f"coalesce({found})"


_PY = f"lower({_first('requirements.txt', 'pyproject.toml', 'Pipfile', 'setup.py')})"
_JAVA = _first("pom.xml", "build.gradle", "build.gradle.kts")
_ENV = f"lower({_first('.env', '.env.example')})"
_DEPS = _all("composer.json", "package.json", "requirements.txt", "pyproject.toml")
_AWS = _all("package.json", "requirements.txt", "pyproject.toml")
_COMPOSE = f"lower({_first('docker-compose.yml', 'docker-compose.yaml')})"
_DB = f"lower(coalesce({_COLUMNS['database.php']}, ''))"
_CORE = f"coalesce({_COLUMNS['CodeIgniter.php']}, '')"
_CORE_VERSION = f"regexp_extract(substr({_CORE}, instr({_CORE}, 'CI_VERSION'), 80), '[0-9]+\\.[0-9]+(?:\\.[0-9]+)?')"
_COMPOSER_SECTIONS, _NPM_SECTIONS = ("require", "require-dev"), ("dependencies", "devDependencies")


def _packaged(manifest: str, sections, frameworks, before: str):
    for package, name in frameworks:
        raw = _version(manifest, sections, package)
        clean = f"ltrim(trim({raw}), '^~>=< ')"
        yield ("framework", f"{raw} IS NOT NULL", text(name), clean, "High", f"'{before} {package} ' || {clean}")


def _fixed(concern, condition, name, evidence, confidence="High"):
    return (concern, condition, text(name), "''", confidence, text(evidence))


_CI3 = f"{_version('composer.json', _COMPOSER_SECTIONS, 'codeigniter/framework')} IS NOT NULL"
_CI4 = f"{_version('composer.json', _COMPOSER_SECTIONS, 'codeigniter4/framework')} IS NOT NULL"
_LARAVEL = f"{_version('composer.json', _COMPOSER_SECTIONS, 'laravel/framework')} IS NOT NULL"
_VENDORED = f"contains({_CORE}, 'CI_VERSION') AND NOT {_CI3} AND NOT {_CI4} AND NOT {_has('spark')}"
_MYSQL_DB = contains_any(_DB, ("mysqli", "'mysql'"))
_SERVERLESS = f"({_has('serverless.yml')} OR {_has('serverless.yaml')})"
_AWS_EVIDENCE = f"""CASE WHEN {_SERVERLESS} THEN 'serverless framework config present' WHEN aws_dir THEN 'AWS config directory present'
  WHEN {contains_any(_AWS, ('aws-sdk', 'boto3', '@aws-sdk/'))} THEN 'AWS SDK in dependencies'
  WHEN aws_file IS NOT NULL THEN 'Terraform AWS provider (' || {basename('aws_file')} || ')' END"""
SIGNALS = [
    _fixed("language", _has("composer.json"), "PHP", "composer.json present"),
    *_packaged("composer.json", _COMPOSER_SECTIONS, technology.PHP_FRAMEWORKS, "composer.json requires"),
    _fixed("framework", f"{_has('artisan')} AND NOT {_LARAVEL}", "Laravel", "artisan console present"),
    _fixed("framework", f"{_has('spark')} AND NOT {_CI4}", "CodeIgniter 4", "spark CLI present"),
    _fixed("language", _VENDORED, "PHP", "CodeIgniter core present"),
    ("framework", _VENDORED,
     f"CASE WHEN starts_with({_CORE_VERSION}, '4') THEN 'CodeIgniter 4' WHEN starts_with({_CORE_VERSION}, '3') THEN 'CodeIgniter 3' ELSE 'CodeIgniter' END",
     _CORE_VERSION, "High", "'vendored CodeIgniter core (system/core/CodeIgniter.php)'"),
    _fixed("language", _has("package.json"), "JavaScript/TypeScript", "package.json present"),
    *_packaged("package.json", _NPM_SECTIONS, technology.NODE_FRAMEWORKS, "package.json depends on"),
    _fixed("language", f"{_PY} <> '' OR {_has('manage.py')}", "Python", "Python manifest present"),
    ("framework", f"{_has('manage.py')} OR contains({_PY}, 'django')", "'Django'", "''", "High",
     f"CASE WHEN {_has('manage.py')} THEN 'manage.py present' ELSE 'Django in dependencies' END"),
    _fixed("framework", f"contains({_PY}, 'fastapi')", "FastAPI", "fastapi in dependencies"),
    _fixed("framework", f"contains({_PY}, 'flask')", "Flask", "flask in dependencies", "Medium"),
    _fixed("language", f"{_JAVA} <> ''", "Java", "Maven/Gradle build file present"),
    _fixed("framework", contains_any(_JAVA, ("spring-boot", "org.springframework")), "Spring", "Spring dependency in build file"),
    _fixed("language", _has("go.mod"), "Go", "go.mod present"),
    _fixed("database", _MYSQL_DB, "MySQL", "dbdriver mysqli in database.php"),
    _fixed("database", f"contains({_DB}, 'postgre') AND NOT {_MYSQL_DB}", "PostgreSQL", "postgre driver in database.php"),
    _fixed("database", f"contains({_ENV}, 'mysql')", "MySQL", "mysql referenced in .env", "Medium"),
    _fixed("database", contains_any(_ENV, ("pgsql", "postgres")), "PostgreSQL", "postgres referenced in .env", "Medium"),
    _fixed("database", f"contains({_ENV}, 'mongo')", "MongoDB", "mongo referenced in .env", "Medium"),
    _fixed("database", contains_any(_DEPS, ("mysqli", "pdo_mysql", "mysql2")), "MySQL", "MySQL driver in dependencies", "Medium"),
    _fixed("database", contains_any(_DEPS, ("psycopg", '"pg"', "pdo_pgsql")), "PostgreSQL", "PostgreSQL driver in dependencies", "Medium"),
    _fixed("database", contains_any(_DEPS, ("mongoose", "pymongo", "mongodb")), "MongoDB", "MongoDB driver in dependencies", "Medium"),
    _fixed("database", contains_any(_COMPOSE, ("image: mysql", "image: mariadb")), "MySQL", "MySQL/MariaDB service in docker-compose"),
    _fixed("database", f"contains({_COMPOSE}, 'image: postgres')", "PostgreSQL", "Postgres service in docker-compose"),
    _fixed("database", f"contains({_COMPOSE}, 'image: mongo')", "MongoDB", "Mongo service in docker-compose"),
    _fixed("infrastructure", _has("Dockerfile"), "Docker", "Dockerfile present"),
    ("infrastructure", f"{_has('docker-compose.yml')} OR {_has('docker-compose.yaml')}", "'Docker Compose'", "''", "High",
     f"CASE WHEN {_has('docker-compose.yml')} THEN 'docker-compose.yml present' ELSE 'docker-compose.yaml present' END"),
    ("infrastructure", "k8s_dir OR k8s_file IS NOT NULL", "'Kubernetes'", "''", "Medium",
     f"CASE WHEN k8s_dir THEN 'kubernetes manifest directory present' ELSE 'Kubernetes manifest detected (' || {basename('k8s_file')} || ')' END"),
    ("infrastructure", f"{_AWS_EVIDENCE} IS NOT NULL", "'AWS'", "''", "Medium", _AWS_EVIDENCE),
]
define(
    "tech_signals",
    "\nUNION ALL\n".join(
        f"SELECT project, '{concern}' AS concern, {i} AS ord, {name} AS name, {version} AS version, '{confidence}' AS confidence, {evidence} AS evidence "
        f"FROM directories LEFT JOIN manifest_bodies USING (project) WHERE {condition}"
        for i, (concern, condition, name, version, confidence, evidence) in enumerate(SIGNALS)
    ),
    "directories", "manifest_bodies",
)
define(
    "tech",
    """
SELECT project, concern, name, coalesce(arg_min(version, ord) FILTER (version <> ''), '') AS version, arg_min(confidence, ord) AS confidence,
  string_agg(evidence, '; ' ORDER BY ord) AS evidence, CAST(min(ord) AS INTEGER) AS ord
FROM tech_signals GROUP BY project, concern, name
""",
    "tech_signals",
)
_OUT = "project, concern, name, version, confidence, evidence"
register("a_24_technology_merge", tech, sql(f"SELECT {_OUT}, ord FROM tech", "tech"))

_DETECTORS = {
    "d_1_php": ["PHP", "CodeIgniter", "CodeIgniter 3", *[n for _, n in technology.PHP_FRAMEWORKS]],
    "d_2_javascript": ["JavaScript/TypeScript", *[n for _, n in technology.NODE_FRAMEWORKS]],
    "d_3_python": ["Python", "Django", "FastAPI", "Flask"],
    "d_4_java_and_go": ["Java", "Spring", "Go"],
    "d_5_databases": ["MySQL", "PostgreSQL", "MongoDB"],
    "d_6_infrastructure": ["Docker", "Docker Compose", "Kubernetes", "AWS"],
}
for _name, _techs in _DETECTORS.items():
    register(
        _name,
        lambda spark, d, techs=tuple(_techs): tech(spark, d).where(F.col("name").isin(*techs)).drop("ord"),
        sql(f"SELECT {_OUT} FROM tech WHERE name IN ({', '.join(text(t) for t in dict.fromkeys(_techs))})", "tech"),
    )


def dependency_maps(spark: SparkSession, d: str) -> DataFrame:
    """Merged dependency map of every composer manifest, one row per package."""
    files = manifest_files(spark, d).where(F.col("path").endswith("composer.json"))
    merged = technology.merged_versions(
        F.col("content"), "require MAP<STRING,STRING>, `require-dev` MAP<STRING,STRING>", "require", "require-dev"
    )
    return files.select("project", "path", F.explode(merged).alias("package", "version")).withColumn(
        "clean", technology.clean_version(F.col("version"))
    )


define(
    "composer_deps",
    """
SELECT project, path, k AS package, json_extract_string(content, '$."' || s || '"."' || k || '"') AS version, s FROM (
  SELECT project, path, content, s, unnest(json_keys(content, '$."' || s || '"')) AS k
  FROM (SELECT * FROM manifest_files WHERE ends_with(path, 'composer.json') AND json_valid(content)), (VALUES ('require'), ('require-dev')) AS t(s))
""",
    "manifest_files",
)
_MERGED = """SELECT project, path, package, arg_min(version, s) AS version FROM composer_deps GROUP BY project, path, package"""
register(
    "u_5_dependency_map_merge",
    lambda spark, d: dependency_maps(spark, d).drop("clean"),
    sql(_MERGED, "composer_deps"),
)
register(
    "x_16_version_clean_and_find",
    lambda spark, d: dependency_maps(spark, d)
    .groupBy("version", "clean")
    .agg(F.count("*").alias("n"))
    .unionByName(
        manifest_files(spark, d)
        .where(F.col("path").endswith("CodeIgniter.php"))
        .groupBy(F.col("content").alias("version"), technology.version_near(F.col("content"), "CI_VERSION").alias("clean"))
        .agg(F.count("*").alias("n"))
    ),
    sql(
        f"""SELECT version, ltrim(trim(version), '^~>=< ') AS clean, count(*) AS n FROM ({_MERGED}) GROUP BY ALL
        UNION ALL
        SELECT content, CASE WHEN contains(content, 'CI_VERSION') THEN regexp_extract(substr(content, instr(content, 'CI_VERSION'), 80), '[0-9]+\\.[0-9]+(?:\\.[0-9]+)?') ELSE '' END, count(*)
        FROM manifest_files WHERE ends_with(path, 'CodeIgniter.php') GROUP BY ALL""",
        "composer_deps", "manifest_files",
    ),
)
