"""Technologies inferred from manifests, config files and directory names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions import paths, text

# The names that are read.
INTERESTING = (
    "composer.json", "package.json", "requirements.txt", "pyproject.toml", "Pipfile", "setup.py",
    "pom.xml", "build.gradle", "build.gradle.kts", "Gemfile", "go.mod", "artisan", "spark",
    "CodeIgniter.php", "manage.py", "Dockerfile", "docker-compose.yml", "docker-compose.yaml",
    "serverless.yml", "serverless.yaml", "database.php", ".env", ".env.example",
)

# Package -> framework, in order.
PHP_FRAMEWORKS = [
    ("laravel/framework", "Laravel"),
    ("codeigniter4/framework", "CodeIgniter 4"),
    ("codeigniter/framework", "CodeIgniter 3"),
    ("symfony/framework-bundle", "Symfony"),
    ("symfony/symfony", "Symfony"),
    ("slim/slim", "Slim"),
    ("cakephp/cakephp", "CakePHP"),
    ("yiisoft/yii2", "Yii 2"),
]
NODE_FRAMEWORKS = [
    ("@nestjs/core", "NestJS"),
    ("next", "Next.js"),
    ("nuxt", "Nuxt"),
    ("@angular/core", "Angular"),
    ("express", "Express"),
    ("koa", "Koa"),
    ("fastify", "Fastify"),
    ("@hapi/hapi", "Hapi"),
    ("react", "React"),
    ("vue", "Vue"),
]
CONCERNS = ("language", "framework", "database", "infrastructure")

_COMPOSER = "require MAP<STRING,STRING>, `require-dev` MAP<STRING,STRING>"
_NPM = "dependencies MAP<STRING,STRING>, devDependencies MAP<STRING,STRING>"


def _name(prefix: str, key: str) -> str:
    """Column name for a manifest or package."""
    return f"{prefix}_{key}".replace(".", "_").replace("/", "_").replace("-", "_").replace("@", "_")


def clean_version(v: Column) -> Column:
    """A version without its constraint prefix."""
    return F.ltrim(text.trim(v), F.lit("^~>=< "))


def version_near(body: Column, keyword: str) -> Column:
    """First dotted number within 80 characters of a keyword; empty if none."""
    at = F.locate(keyword, body)
    window = F.substring(body, at, F.lit(80))
    return F.when(
        at > 0, F.regexp_extract(window, r"[0-9]+\.[0-9]+(?:\.[0-9]+)?", 0)
    ).otherwise("")


def merged_versions(body: Column, schema: str, first: str, second: str) -> Column:
    """Dependency map of a manifest; entries of ``first`` win over ``second``."""
    parsed = F.from_json(body, schema)
    none = F.create_map().cast("map<string,string>")
    own, extra = F.coalesce(parsed[first], none), F.coalesce(parsed[second], none)
    return F.map_concat(own, F.map_filter(extra, lambda k, _: ~F.map_contains_key(own, k)))


def _outside(files: DataFrame) -> DataFrame:
    """Files outside ignored directories, with their name and their place in walk order."""
    return files.where(~F.coalesce(F.col("is_dir"), F.lit(False)) & ~paths.in_ignored_dir(F.col("path"))).withColumns(
        {"name": paths.basename(F.col("path")), "place": paths.parts(F.col("path"))}
    )


def first_manifests(files: DataFrame) -> DataFrame:
    """``(project, name, path)``: the first file of every interesting name in walk order.

    Paths alone decide, so contents are neither read nor shuffled.
    """
    named = _outside(files.select("project", "path", "is_dir")).where(F.col("name").isin(*INTERESTING))
    return named.groupBy("project", "name").agg(F.array_join(F.min("place"), "/").alias("path"))


def scanned(files: DataFrame, exts: tuple[str, ...]) -> DataFrame:
    """The files with one of the extensions, outside ignored directories."""
    return files.where(
        ~F.coalesce(F.col("is_dir"), F.lit(False))
        & ~paths.in_ignored_dir(F.col("path"))
        & paths.extension(F.col("path")).isin(*exts)
    )


def _seen(names: Column, *wanted: str) -> Column:
    return F.arrays_overlap(names, F.array(*[F.lit(w) for w in wanted]))


def _versions(deps: Column, frameworks: list[tuple[str, str]]) -> Column:
    """Versions of the frameworks' packages, null where they are not required; ``deps`` is evaluated once."""
    return F.get(F.transform(F.array(deps), lambda d: F.array(*[d[p] for p, _ in frameworks])), 0)


def telling_files(files: DataFrame) -> DataFrame:
    """``(project, name, place, k8s, aws, k8s_dir, aws_dir, says)`` of all that may be a signal.

    ``name`` and ``says``, what a manifest says as small flags and versions, are null but for
    interesting names; ``k8s`` and ``aws`` mark Kubernetes YAML and AWS Terraform, the last two
    flags telling directory names at or above the entry.
    """
    path, body = F.col("path"), F.col("content")
    is_dir = F.coalesce(F.col("is_dir"), F.lit(False))
    ext = paths.extension(path)
    kubernetes = (
        body.contains("apiVersion:") & body.contains("kind:") & text.contains_any(body, ("Deployment", "Service", "Pod"))
    )
    names = F.transform(F.when(is_dir, paths.parts(path)).otherwise(paths.directories(path)), F.lower)
    name = F.when(~is_dir & paths.basename(path).isin(*INTERESTING), paths.basename(path))
    rows = files.where(~paths.in_ignored_dir(path) & ~(is_dir & paths.basename(path).isin(*paths.IGNORED_DIRS))).select(
        "project",
        "content",
        name.alias("name"),
        paths.parts(path).alias("place"),
        F.coalesce(~is_dir & ext.isin(".yaml", ".yml") & kubernetes, F.lit(False)).alias("k8s"),
        F.coalesce(~is_dir & (ext == ".tf") & body.contains('provider "aws"'), F.lit(False)).alias("aws"),
        _seen(names, "k8s", "kubernetes", "manifests", "charts").alias("k8s_dir"),
        _seen(names, ".aws", ".ebextensions").alias("aws_dir"),
    )
    telling = rows.where(F.col("name").isNotNull() | F.col("k8s") | F.col("aws") | F.col("k8s_dir") | F.col("aws_dir"))
    name, low = F.col("name"), F.lower("content")
    php = merged_versions(body, _COMPOSER, "require", "require-dev")
    npm = merged_versions(body, _NPM, "dependencies", "devDependencies")
    says = {
        "filled": body != "",
        "core": body.contains("CI_VERSION"),
        "core_version": F.when(name == "CodeIgniter.php", version_near(body, "CI_VERSION")),
        "php": F.when(name == "composer.json", _versions(php, PHP_FRAMEWORKS)),
        "npm": F.when(name == "package.json", _versions(npm, NODE_FRAMEWORKS)),
        "django": low.contains("django"),
        "fastapi": low.contains("fastapi"),
        "flask": low.contains("flask"),
        "spring": text.contains_any(body, ("spring-boot", "org.springframework")),
        "cfg_mysql": text.contains_any(low, ("mysqli", "'mysql'")),
        "cfg_postgres": low.contains("postgre"),
        "env_mysql": low.contains("mysql"),
        "env_postgres": text.contains_any(low, ("pgsql", "postgres")),
        "env_mongo": low.contains("mongo"),
        "dep_mysql": text.contains_any(low, ("mysqli", "pdo_mysql", "mysql2")),
        "dep_postgres": text.contains_any(low, ("psycopg", '"pg"', "pdo_pgsql")),
        "dep_mongo": text.contains_any(low, ("mongoose", "pymongo", "mongodb")),
        "img_mysql": text.contains_any(low, ("image: mysql", "image: mariadb")),
        "img_postgres": low.contains("image: postgres"),
        "img_mongo": low.contains("image: mongo"),
        "aws_sdk": text.contains_any(low, ("aws-sdk", "boto3", "@aws-sdk/")),
    }
    return telling.select(
        "project", "name", "place", "k8s", "aws", "k8s_dir", "aws_dir",
        F.when(name.isNotNull(), F.struct(*[c.alias(k) for k, c in says.items()])).alias("says"),
    )


def project_signals(files: DataFrame) -> DataFrame:
    """One row per project: what its first manifest of each name says, and its first files
    and directories that tell of an infrastructure.

    One aggregate decides the firsts of all names in walk order. Contents stay where they
    are read; flags and versions travel, after a partial aggregate in every task.
    """
    first = {
        m: F.min(F.when(F.col("name") == m, F.struct("place", "says"))).alias(_name("m", m)) for m in INTERESTING
    }
    firsts = telling_files(files).groupBy("project").agg(
        *first.values(),
        F.array_join(F.min(F.when(F.col("k8s"), F.col("place"))), "/").alias("k8s_file"),
        F.array_join(F.min(F.when(F.col("aws"), F.col("place"))), "/").alias("aws_file"),
        F.bool_or("k8s_dir").alias("k8s_dir"),
        F.bool_or("aws_dir").alias("aws_dir"),
    )

    def says(manifest: str, key: str) -> Column:
        return F.col(_name("m", manifest))["says"][key]

    def first_filled(manifests: tuple[str, ...], key: str, alias: str) -> Column:
        """The flag of the first manifest that is not empty."""
        return F.coalesce(*[F.when(says(m, "filled"), says(m, key)) for m in manifests], F.lit(False)).alias(alias)

    def any_of(manifests: tuple[str, ...], key: str, alias: str) -> Column:
        flags = [F.coalesce(says(m, key), F.lit(False)) for m in manifests]
        return reduce(lambda x, y: x | y, flags).alias(alias)

    python = ("requirements.txt", "pyproject.toml", "Pipfile", "setup.py")
    java = ("pom.xml", "build.gradle", "build.gradle.kts")
    env = (".env", ".env.example")
    compose = ("docker-compose.yml", "docker-compose.yaml")
    dependency = ("composer.json", "package.json", "requirements.txt", "pyproject.toml")
    return firsts.select(
        "project", "k8s_file", "aws_file", "k8s_dir", "aws_dir",
        *[F.col(_name("m", m)).isNotNull().alias(_name("has", m)) for m in INTERESTING],
        *[says("composer.json", "php")[i].alias(_name("php", p)) for i, (p, _) in enumerate(PHP_FRAMEWORKS)],
        *[says("package.json", "npm")[i].alias(_name("npm", p)) for i, (p, _) in enumerate(NODE_FRAMEWORKS)],
        any_of(("CodeIgniter.php",), "core", "core"),
        F.coalesce(says("CodeIgniter.php", "core_version"), F.lit("")).alias("core_version"),
        any_of(python, "filled", "python"),
        *[first_filled(python, c, c) for c in ("django", "fastapi", "flask")],
        any_of(java, "filled", "java"),
        first_filled(java, "spring", "spring"),
        *[any_of(("database.php",), c, c) for c in ("cfg_mysql", "cfg_postgres")],
        *[first_filled(env, c, c) for c in ("env_mysql", "env_postgres", "env_mongo")],
        *[any_of(dependency, c, c) for c in ("dep_mysql", "dep_postgres", "dep_mongo")],
        *[first_filled(compose, c, c) for c in ("img_mysql", "img_postgres", "img_mongo")],
        any_of(("package.json", "requirements.txt", "pyproject.toml"), "aws_sdk", "aws_sdk"),
    )


def _signal_list() -> list[tuple[str, Column, Column, Column, str, Column]]:
    """``(concern, condition, name, version, confidence, evidence)`` in signal order."""
    none, true = F.lit(""), F.lit(True)

    def has(manifest: str) -> Column:
        return F.col(_name("has", manifest))

    def fixed(concern, condition, name, evidence, confidence="High", version=none):
        return (concern, condition, F.lit(name), version, confidence, F.lit(evidence))

    def packaged(prefix: str, frameworks, text_before: str):
        out = []
        for package, name in frameworks:
            version = clean_version(F.col(_name(prefix, package)))
            evidence = F.concat(F.lit(f"{text_before} {package} "), version)
            present = F.col(_name(prefix, package)).isNotNull()
            out.append(("framework", present, F.lit(name), version, "High", evidence))
        return out

    laravel = F.col(_name("php", "laravel/framework")).isNotNull()
    ci4 = F.col(_name("php", "codeigniter4/framework")).isNotNull()
    ci3 = F.col(_name("php", "codeigniter/framework")).isNotNull()
    core = has("CodeIgniter.php") & F.col("core") & ~ci3 & ~ci4 & ~has("spark")
    core_name = (
        F.when(F.col("core_version").startswith("4"), "CodeIgniter 4")
        .when(F.col("core_version").startswith("3"), "CodeIgniter 3")
        .otherwise("CodeIgniter")
    )
    manage = has("manage.py")
    k8s_dir, aws_dir = F.col("k8s_dir"), F.col("aws_dir")
    serverless = has("serverless.yml") | has("serverless.yaml")
    aws = (
        F.when(serverless, F.lit("serverless framework config present"))
        .when(aws_dir, F.lit("AWS config directory present"))
        .when(F.col("aws_sdk"), F.lit("AWS SDK in dependencies"))
        .when(
            F.col("aws_file").isNotNull(),
            F.concat(F.lit("Terraform AWS provider ("), paths.basename(F.col("aws_file")), F.lit(")")),
        )
    )
    k8s = F.when(k8s_dir, F.lit("kubernetes manifest directory present")).otherwise(
        F.concat(F.lit("Kubernetes manifest detected ("), paths.basename(F.col("k8s_file")), F.lit(")"))
    )
    compose = has("docker-compose.yml") | has("docker-compose.yaml")
    compose_file = F.when(has("docker-compose.yml"), "docker-compose.yml present").otherwise(
        "docker-compose.yaml present"
    )
    signals = [
        fixed("language", has("composer.json"), "PHP", "composer.json present"),
        *packaged("php", PHP_FRAMEWORKS, "composer.json requires"),
        fixed("framework", has("artisan") & ~laravel, "Laravel", "artisan console present"),
        fixed("framework", has("spark") & ~ci4, "CodeIgniter 4", "spark CLI present"),
        fixed("language", core, "PHP", "CodeIgniter core present"),
        ("framework", core, core_name, F.col("core_version"), "High",
         F.lit("vendored CodeIgniter core (system/core/CodeIgniter.php)")),
        fixed("language", has("package.json"), "JavaScript/TypeScript", "package.json present"),
        *packaged("npm", NODE_FRAMEWORKS, "package.json depends on"),
        fixed("language", F.col("python") | manage, "Python", "Python manifest present"),
        ("framework", manage | F.col("django"), F.lit("Django"), none, "High",
         F.when(manage, "manage.py present").otherwise("Django in dependencies")),
        fixed("framework", F.col("fastapi"), "FastAPI", "fastapi in dependencies"),
        fixed("framework", F.col("flask"), "Flask", "flask in dependencies", "Medium"),
        fixed("language", F.col("java"), "Java", "Maven/Gradle build file present"),
        fixed("framework", F.col("spring"), "Spring", "Spring dependency in build file"),
        fixed("language", has("go.mod"), "Go", "go.mod present"),
        fixed("database", F.col("cfg_mysql"), "MySQL", "dbdriver mysqli in database.php"),
        fixed("database", F.col("cfg_postgres") & ~F.col("cfg_mysql"), "PostgreSQL",
              "postgre driver in database.php"),
        fixed("database", F.col("env_mysql"), "MySQL", "mysql referenced in .env", "Medium"),
        fixed("database", F.col("env_postgres"), "PostgreSQL", "postgres referenced in .env", "Medium"),
        fixed("database", F.col("env_mongo"), "MongoDB", "mongo referenced in .env", "Medium"),
        fixed("database", F.col("dep_mysql"), "MySQL", "MySQL driver in dependencies", "Medium"),
        fixed("database", F.col("dep_postgres"), "PostgreSQL", "PostgreSQL driver in dependencies", "Medium"),
        fixed("database", F.col("dep_mongo"), "MongoDB", "MongoDB driver in dependencies", "Medium"),
        fixed("database", F.col("img_mysql"), "MySQL", "MySQL/MariaDB service in docker-compose"),
        fixed("database", F.col("img_postgres"), "PostgreSQL", "Postgres service in docker-compose"),
        fixed("database", F.col("img_mongo"), "MongoDB", "Mongo service in docker-compose"),
        fixed("infrastructure", has("Dockerfile"), "Docker", "Dockerfile present"),
        ("infrastructure", compose, F.lit("Docker Compose"), none, "High", compose_file),
        ("infrastructure", k8s_dir | F.col("k8s_file").isNotNull(), F.lit("Kubernetes"), none, "Medium", k8s),
        ("infrastructure", aws.isNotNull(), F.lit("AWS"), none, "Medium", aws),
    ]
    return signals


def technologies(files: DataFrame) -> DataFrame:
    """``(project, concern, name, version, confidence, evidence, ord)``: one row per technology.

    Signals of one name are merged: evidence in signal order, the first confidence and the
    first version that is not empty. A project has at most one signal of each kind, so the
    merged lists are bounded.
    """
    candidates = [
        F.when(
            condition,
            F.struct(
                F.lit(concern).alias("concern"),
                F.lit(i).alias("ord"),
                name.alias("name"),
                version.alias("version"),
                F.lit(confidence).alias("confidence"),
                evidence.alias("evidence"),
            ),
        )
        for i, (concern, condition, name, version, confidence, evidence) in enumerate(_signal_list())
    ]
    found = project_signals(files).select("project", F.array_compact(F.array(*candidates)).alias("found"))
    # The few signals of a project are merged in their row.
    kinds = F.array_distinct(F.transform("found", lambda t: F.struct(t["concern"], t["name"])))
    rows = found.select("project", F.explode(F.transform(kinds, _merged)).alias("t")).select("project", "t.*")
    return rows.select("project", "concern", "name", "version", "confidence", "evidence", "ord")


def _merged(kind: Column) -> Column:
    """The signals in ``found`` of one concern and name as one."""
    same = F.filter("found", lambda t: (t["concern"] == kind["concern"]) & (t["name"] == kind["name"]))
    versions = F.filter(F.transform(same, lambda t: t["version"]), lambda v: v != "")
    return F.struct(
        kind["concern"].alias("concern"),
        kind["name"].alias("name"),
        F.coalesce(F.get(versions, 0), F.lit("")).alias("version"),
        F.get(same, 0)["confidence"].alias("confidence"),
        F.transform(same, lambda t: t["evidence"]).alias("evidence"),
        F.get(same, 0)["ord"].alias("ord"),
    )


def stack_names(tech: DataFrame, concerns: tuple[str, ...] = CONCERNS) -> DataFrame:
    """Names per project, by concern in the given order, then in signal order."""
    position = F.array_position(F.array(*[F.lit(c) for c in concerns]), F.col("concern"))
    return (
        tech.where(F.col("concern").isin(*concerns))
        .groupBy("project")
        .agg(F.sort_array(F.collect_list(F.struct(position.alias("c"), "ord", "name"))).alias("_n"))
        .select("project", F.transform("_n", lambda n: n["name"]).alias("names"))
    )
