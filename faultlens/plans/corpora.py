"""Code-, log- and finding-shaped tables derived from the shared test tables.

The shared tables hold almost no text of these shapes, so each corpus is computed from
their keys by integer arithmetic on fixed templates. ``corpora_sql`` builds the same
rows in SQL. Every corpus keeps one row (or a fixed number of rows) per input row, and a
third of the rows falls to one project.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.operators import rulebook as rb

LOG_MESSAGES = [
    "Query error: SQLSTATE[HY000] [2002] Connection refused (host 10.0.{k}.{u})",
    "Deadlock found when trying to get lock; try restarting transaction 'trx-{k}'",
    'Lock wait timeout exceeded on "order_{u}"',
    "cURL error 28: Operation timed out after {k} ms",
    "Unauthorized access for user 'u{u}' from 192.168.0.{k}",
    "Allowed memory size of {k}000 bytes exhausted",
    "Upstream returned 504 for request 0x{k}ff",
    "Maximum execution time of {k} seconds exceeded",
    "Undefined index:   user_{u}  in   Cart.php line {k}",
    "Too many connections from worker {u}",
    "Query timeout on report sql " + "with a very long context " * 9 + "{k}",
]
DASHED_LEVELS = ["ERROR", "CRITICAL", "Warning", "DEBUG", "INFO", "error", "NOTICE", "ALL"]
BRACKETED_LEVELS = ["ERROR", "CRITICAL", "WARNING", "ALERT", "EMERGENCY", "NOTICE", "INFO", "debug"]
RUNTIME_TYPES = ["DatabaseException", "LogicException", "E_ERROR", "TypeError"]
RUNTIME_SEVERITIES = ["fatal", "error", "warning", "notice", ""]
RUNTIME_MESSAGES = [
    "SQLSTATE[HY000] Connection refused {u}",
    "Payment gateway timeout after {k}s",
    "Allowed memory size exhausted",
]

_AWS = "AKIA" + "Q7" * 8
_STRIPE = "sk_live_" + "z9" * 6
_GOOGLE = "AIza" + "b5-_X" * 7
_GITHUB = "ghp_" + "c4D" * 12
_LONG = "x" * 520

SOURCE_LINES = [
    "<?php", "", "   ", "// plain comment eval(", "# hash comment eval(", "* star comment system(",
    "<!-- html comment -->", "/* one line eval( */", "/* opens here", "still inside eval($x);",
    "closes */ eval($y);", "both */ then /* again", "$v = 1; /* tail opens", "*/",
    "eval($code);", "$a = shell_exec ('ls');", "my_eval($x);", "medieval ($x);",
    "const r = eval (src);", "EVAL(src)", "$n = $_GET['name'];", "$n = $_post['name'];",
    "ini_set('display_errors', 1);", "display_errors = off", "'db_debug' => TRUE,", "'db_debug' => false,",
    'q = "SELECT * FROM users"', "select  *  from t where 1", "SELECT a FROM t",
    "WHERE name LIKE '%abc'", "WHERE name LIKE 'abc%'", "$h = md5($password);", "$h = md5($body);",
    "include $_GET['page'];", "$include = $_GET['x'];", "require_once ( $_COOKIE['p']);",
    "curl_init($_POST['u']);", "curl_init($url); $x = $_POST['u'];", "unserialize($_REQUEST['d']);",
    "curl_setopt($c, CURLOPT_SSL_VERIFYPEER, false);", "'verify' => 0,", "'verify' => true,",
    "<div dangerouslySetInnerHTML={x} />", "document.write(x)", "el.innerHTML = y", "el.innerHTML",
    "require('child_process')", "result = eval(expr)", "model.eval()", "os.system(cmd)",
    "subprocess.run(cmd, shell=True)", "shell = false", "pickle.loads(b)", "yaml.load(f)", "YAML.load(f)",
    "requests.get(u, verify=False)", "Runtime.getRuntime().exec(cmd);", "new  ProcessBuilder (a);",
    'st.executeQuery("SELECT 1" + id);', 'st.executeQuery("SELECT 1");', "new ObjectInputStream(s);",
    "o.readObject ();", 'MessageDigest.getInstance("MD5")', 'MessageDigest.getInstance("SHA-256")',
    'instance_eval "code"', 'system("ls")', "%x{ls}", "Marshal.load (d)",
    f"$k = '{_AWS}';", f"key: {_STRIPE} # live", "-----BEGIN RSA PRIVATE KEY-----", f'g = "{_GOOGLE}"',
    f"// {_GITHUB}", "$password = 'Sup3rS3cret!';", "password: 'changeme-please'", "'api_key' => \"ab12cd34ef\",",
    'secret = "two words"', "pwd = 'abc'", 'auth_token = "$tok123456"',
    '$q = "SELECT id FROM t WHERE id=" . $id;', "`SELECT id FROM t WHERE id=${id}`", "delete from $url",
    "echo $_GET['q'];", "echo htmlspecialchars($_GET['q']);", "<?= $_COOKIE['c'] ?>",
    "$u->first()->name;", "$u -> find(1) -> name;", "$u->first();", "} catch (Exception $e) {}",
    "} catch (Exception $e) {", "catch (e) { log(e); }", "  }", "}", "// only a comment",
    "$x = 'http://host/path'; eval($x); // eval", "s = 'a # b'; eval(s) # eval", "#[Attr] eval($z);",
    "u = \"it's // fine\" // pickle.load(", "eval(a) // " + _LONG, "x = 'open // eval(b)",
    "total = price * qty", "return $this->load;",
]
DIRS = [
    "", "src/", "app/models/", "application/config/", "tests/unit/", "vendor/lib/", "assets/js/",
    "resources/lang/en/", "web/node_modules/x/", "Dist/a/", "Third_Party/z/", "system/helpers/",
    "modules/System/lib/", "app/Http/Controllers/", "database/seeders/", "build/out/", "app/Views/",
]
NAMES = [
    "BookingController", "payment_service", "user.model", "app.min", "lib-min", "index", "util_test",
    "config", "main", "create_migration", "home.blade", "x.test", "settings.example",
]
EXTS = [".php", ".js", ".ts", ".py", ".java", ".rb", ".PHP", ".tsx", ".go", ".jsx", ".html", ".md", ".cs", ""]

CONFIG_NAMES = [
    "Dockerfile", "docker-compose.yml", ".env", "nginx.conf", "pod.yaml", ".env.example", ".htaccess",
    "values.yml", "web.dockerfile", "compose.yaml", ".env.production", "Dockerfile.dev", "httpd.conf",
]
CONFIG_LINES = [
    "", "# USER root", "USER root", "  user root  ", "USER app", "FROM node:latest", "FROM node:20",
    "FROM node:latest AS build", "ADD https://x.example/a.tar /a", "ADD ./a /a",
    "RUN curl -sL https://x.example/i.sh | sudo bash", "RUN wget x || echo sh", "ENV API_KEY=abcd1234",
    "ARG DB_PASSWORD abc12345", "ENV TOKEN=$TOKEN", "    privileged: true", "    privileged: false",
    "    network_mode: \"host\"", "    network_mode: bridge", '      - "3306:3306"', '      - "127.0.0.1:5432:5432"',
    "      - 0.0.0.0:6379:6379", "      - 8080:80", "  hostPath:", "  - image: nginx:latest", "    image: nginx:1.25",
    "APP_DEBUG=true", "DEBUG=1", "APP_DEBUG=false", "DB_PASSWORD=s3cr3tvalue", "API_TOKEN=\"changeme123\"",
    "SECRET_KEY=${SECRET}", "SECRET=short", "MAIL_PASSWORD=null", "autoindex on;", "autoindex off;",
    "Options +Indexes FollowSymLinks", "Options -MultiViews # Indexes", "server_tokens on;", "ServerTokens Full",
    "ServerTokens Prod", "ssl_protocols TLSv1 TLSv1.2;", "ssl_protocols TLSv1.2 TLSv1.3;", "SSLProtocol all SSLv3",
    "listen 80;", "replicas: 2",
]

COMPOSER = [
    '{"require": {"php": ">=5.6", "laravel/framework": "^8.1"}, "require-dev": {"slim/slim": "*"}}',
    '{"require": {"php": "^8.1", "codeigniter4/framework": "~4.4.0", "ext-pdo_mysql": "1.0"}}',
    '{"require": {"php": "7.3.1", "symfony/symfony": "5.4.1", "symfony/framework-bundle": "5.4.0"},\n'
    '"require-dev": {"symfony/symfony": "9.9"}}',
    '{"require": {"php": "7.4", "mongodb/mongodb": "1.0",\n "cakephp/cakephp": "dev-master"}}',
    "not json at all mysqli",
]
PACKAGE = [
    '{"dependencies": {"express": "^4.18.2", "react": "latest", "mysql2": "1.0"}}',
    '{"dependencies": {"next": "13.0.1"}, "devDependencies": {"vue": ">=0"}}',
    '{"devDependencies": {"@nestjs/core": "~9.0.0", "@aws-sdk/client-s3": "3.1.0"}}',
    '{"name": "empty"}',
]
REQUIREMENTS = [
    "Django==3.2.{n}\nrequests>=2.0\n# comment\npsycopg2==2.9.1\n",
    "fastapi==0.95.{n}\npymongo\n",
    "flask==1.{n}.0\nboto3\n",
    "",
]
COMPOSE = [
    "services:\n  db:\n    image: mysql:8\n",
    "services:\n  db:\n    image: Postgres:15\n",
    "services:\n  m:\n    image: mongo\n  d:\n    image: mariadb\n",
]
ENVS = ["DB_CONNECTION=mysql\n", "DATABASE_URL=postgres://x\n", "MONGO_URL=mongodb://y\n", "APP=1\n"]
DATABASE_PHP = ["'dbdriver' => 'mysqli',", "'dbdriver' => 'postgre',", "'dbdriver' => 'sqlite3',"]
K8S_YAML = "apiVersion: apps/v1\nkind: Deployment\n"
CORE_PHP = ["const CI_VERSION = '3.1.{n}';", "const CI_VERSION = '4.{n}.0';", "// no version"]
LOCK = (
    '{"packages": [{"name": "monolog/monolog", "version": "1.{n}.0"}], '
    '"packages-dev": [{"name": "phpunit/phpunit", "version": "9.{n}.1"}]}'
)

FINDING_RULES = [*rb.RULE_META, "DOCKER_USER_ROOT", "PERF_SELECT_STAR", "SEMGREP:echoed-request"]
FINDING_SEVERITIES = ["High", "Medium", "Low", "Critical", "High", "Low", "Medium", "Info"]
FINDING_CATEGORIES = [
    "Security", "Database", "Error Handling", "Performance", "Configuration", "Dependencies", "Infrastructure",
]
ECOSYSTEMS = ["Packagist", "PyPI", "npm", "Go"]
ADVISORY_SEVERITIES = ["CRITICAL", "HIGH", "medium", "Low"]

SEMGREP_REPORT = (
    '{"results": [{"check_id": "php.lang.rule-{n}", "path": "src/f{n}.php", "start": {"line": {n}}, '
    '"extra": {"message": "First {n}.\\nSecond.", "severity": "{s}", "lines": "  echo {n};\\nx", '
    '"metadata": {"cwe": ["CWE-79: Cross-site Scripting"], "owasp": "A03:2021 - Injection", "category": "security"}}}, '
    '{"check_id": "plain{n}.", "path": "src/g.php", "start": {"line": 3}, '
    '"extra": {"message": "Slow.", "severity": "WARNING", "lines": "", '
    '"metadata": {"cwe": "CWE-1050", "category": "{c}"}}}]}'
)
BANDIT_REPORT = (
    'noise before {"results": [{"filename": "/srv/app/f{n}.py", "issue_severity": "{s}", '
    '"issue_text": "call {n} with\\nshell", "test_id": "B60{d}", "line_number": 42, '
    '"code": "41 import os\\n42 run(cmd{n})\\n", "issue_cwe": {"id": 78}}, '
    '{"filename": "lib/g.py", "issue_severity": "odd", "issue_text": "text", "test_id": "B1", '
    '"line_number": 9, "code": "1 first()\\n2 second()"}]}'
)
GOSEC_REPORT = (
    '{"Issues": [{"severity": "{s}", "rule_id": "G{n}", "details": "Detail {n}", "file": "/srv/app/cmd/m{d}.go", '
    '"code": " 12: x ", "line": "{n}-99", "cwe": {"id": "327"}}, '
    '{"severity": "LOW", "rule_id": "G1", "details": "d", "file": "/other/x.go", "code": "c", "line": "zz"}]}'
)
ESLINT_REPORT = (
    '[{"filePath": "/srv/app/a{n}.js", "messages": [{"ruleId": "no-eval", "severity": 2, "message": "Bad {n}.", "line": {n}}, '
    '{"ruleId": null, "severity": 1, "message": "Parse", "line": 1}]}, {"filePath": "b.js", "messages": []}]'
)
PHPSTAN_REPORT = (
    '{"files": {"/srv/app/z{n}.php": {"messages": [{"message": "Undefined {n}", "line": {n}, "identifier": "variable.undefined"}]}, '
    '"src/a.php": {"messages": [{"message": "Other", "line": 2}]}}}'
)
REPORT_SEVERITIES = ["ERROR", "HIGH", "MEDIUM", "WARNING", "INFO"]
REPORT_CATEGORIES = ["performance", "correctness", "best-practice", "other"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when the input is a handful of files; large tables stay as read."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if len(df.inputFiles()) < wanted else df


def as_table(df: DataFrame) -> DataFrame:
    """Keep the derivation apart from what reads it, as a stored table would.

    Without the generator the optimizer would inline the text expressions into every
    filter and function of the operator under test.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def with_content(named: DataFrame, content: Column, size: Column) -> DataFrame:
    """A files table of ``named(project, path, ...)``; a null ``size`` is that of the content.

    The content is an operator of its own above the paths: filters on paths go below it, so
    that contents are built for the files that are read, and once for each.
    """
    filled = named.select("*", F.explode(F.array(content)).alias("content"))
    return filled.select(
        "project",
        "path",
        F.lit(False).alias("is_dir"),
        F.coalesce(size, F.octet_length("content")).cast("long").alias("size"),
        "content",
    )


def pick(items: list[str], index: Column) -> Column:
    """``items[index % len]``; the items are one literal that is split once, at planning."""
    chosen = F.split(F.lit("\x1e".join(items)), "\x1e", -1)
    return F.element_at(chosen, (index % len(items) + 1).cast("int"))


def fill(template: Column, **values: Column) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template


def div(c: Column, n: int) -> Column:
    return F.floor(c / n).cast("long")


def numbered_lines(key: Column, count: Column, most: int, line) -> Column:
    """``line(1)`` to ``line(count)`` as one text, ``count`` up to ``most``; null without a key.

    Spelled out rather than a transform over a sequence, which is not compiled.
    """
    lines = [F.when(count >= i, line(F.lit(i))) for i in range(1, most + 1)]
    return F.when(key.isNotNull(), F.concat_ws("\n", *lines))


def skewed_project(key: Column, n: int, prefix: str = "p") -> Column:
    return F.concat(F.lit(prefix), F.when(key % 3 == 0, F.lit(0)).otherwise(key % n).cast("string"))


def _event_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spread(
        table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    )
    return with_event_keys(events)


def with_event_keys(events: DataFrame) -> DataFrame:
    return events.withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("long"))


def log_line_columns(events: DataFrame) -> DataFrame:
    """``(project, source_file, line_order, value)`` plus ``ts`` of the event."""
    e = F.col("event_id")
    text = F.concat(
        fill(pick(LOG_MESSAGES, e), k=F.col("k"), u=F.col("user_id")), F.lit(" during "), F.col("event_type")
    )
    when = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    step = div(e, 5)
    dashed = F.concat(pick(DASHED_LEVELS, step), F.lit(" - "), when, F.lit(" --> "), text)
    bracketed = F.concat(F.lit("["), when, F.lit("] production."), pick(BRACKETED_LEVELS, step), F.lit(": "), text)
    other = (
        F.when(step % 4 == 0, F.concat(F.lit("PHP Fatal error: "), text))
        .when(step % 4 == 1, F.lit("   "))
        .when(step % 4 == 2, F.concat(text, F.lit(" exception thrown")))
        .otherwise(F.concat(F.lit("started worker "), F.col("k").cast("string")))
    )
    value = F.when(e % 5 < 2, dashed).when(e % 5 < 4, bracketed).otherwise(other)
    indented = F.when(e % 13 == 0, F.concat(F.lit("  "), value, F.lit(" \r"))).otherwise(value)
    project = skewed_project(F.col("user_id"), 17)
    return as_table(
        events.select(
            project.alias("project"),
            F.concat(project, F.lit("/app-"), (e % 5).cast("string"), F.lit(".log")).alias("source_file"),
            e.alias("line_order"),
            indented.alias("value"),
            "ts",
        )
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_line_columns(_event_columns(spark, sf_dir)).drop("ts")


def runtime_line_columns(events: DataFrame) -> DataFrame:
    """``(project, event_order, value)``: one JSON object per event, some malformed."""
    e, k = F.col("event_id"), F.col("k").cast("string")
    stamp = F.concat(
        F.lit('"timestamp": "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm"), F.lit(':00+00:00", ')
    )
    kind = F.concat(F.lit('"type": "'), pick(RUNTIME_TYPES, e), F.lit('", '))
    message = F.concat(
        F.lit('"message": "'),
        fill(pick(RUNTIME_MESSAGES, div(e, 4)), k=F.col("k"), u=F.col("user_id")),
        F.lit('", '),
    )
    file = F.concat(F.lit('"file": "app/M'), (F.col("user_id") % 4).cast("string"), F.lit('.php", '))
    tail = F.concat(
        F.lit('"trace": "", "url": "/u", "severity": "'), pick(RUNTIME_SEVERITIES, div(e, 3)), F.lit('", '),
        F.lit('"app": null, '),
    )
    line = F.concat(F.lit('"line": '), (F.col("k") % 10).cast("string"), F.lit("}"))
    value = (
        F.when(e % 97 == 5, F.concat(F.lit("not json "), e.cast("string")))
        .when(e % 89 == 7, F.concat(F.lit("{"), stamp, kind, message, file, tail, F.lit('"line": "'), k, F.lit('"}')))
        .when(e % 83 == 3, F.concat(F.lit("{"), kind, message, file, tail, line))
        .when(e % 79 == 2, F.concat(F.lit("{"), stamp, F.lit('"type": 5, '), message, file, tail, line))
        .otherwise(F.concat(F.lit("{"), stamp, kind, message, file, tail, line))
    )
    return as_table(
        events.select(
            skewed_project(F.col("user_id"), 17).alias("project"), e.alias("event_order"), value.alias("value")
        )
    )


def runtime_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime_line_columns(_event_columns(spark, sf_dir))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file of 6 to 14 lines per order."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey"))
    o = F.col("o_orderkey")
    text = numbered_lines(o, o % 9 + 6, 14, lambda i: pick(SOURCE_LINES, o * 7 + i * 13 + div(o, 16) * i))
    content = F.when(o % 11 == 0, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)
    block = div(o, 97)
    module = F.concat(F.lit("m"), block.cast("string"), F.lit("/"))
    folder = pick(DIRS, o)
    file = F.concat(
        F.when(folder.contains("ystem/"), module).otherwise(F.lit("")),
        folder, pick(NAMES, div(o, 3)), F.lit("_"), o.cast("string"), pick(EXTS, div(o, 7)),
    )
    # Every second block of orders holds a framework core that hides its system files.
    path = F.when((o % 97 == 0) & (block % 2 == 0), F.concat(module, F.lit("system/core/CodeIgniter.php"))).otherwise(file)
    named = as_table(orders.select(skewed_project(block, 41).alias("project"), path.alias("path"), o))
    return with_content(named, content, F.when(o % 401 == 0, F.lit(3_000_000)))


def config_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One configuration file of 5 to 12 lines per part."""
    parts = spread(table(spark, sf_dir, "part").select("p_partkey"))
    p = F.col("p_partkey")
    name = pick(CONFIG_NAMES, p)
    lines = numbered_lines(p, p % 8 + 5, 12, lambda i: pick(CONFIG_LINES, p * 5 + i * 11 + div(p, 13) * i))
    head = F.when(name == "pod.yaml", F.lit("apiVersion: v1\nkind: Pod\n")).otherwise(F.lit(""))
    content = F.concat(head, lines)
    path = F.concat(F.lit("svc"), p.cast("string"), F.lit("/"), name)
    named = as_table(parts.select(skewed_project(p, 29).alias("project"), path.alias("path"), p))
    return with_content(named, content, F.when(p % 211 == 0, F.lit(600_000)))


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to twenty manifests and config files per customer, each customer a project."""
    customers = spread(table(spark, sf_dir, "customer").select("c_custkey"))
    c = F.col("c_custkey")
    n = c % 7

    def when(condition: Column, path: str, content: Column) -> Column:
        return F.when(condition, F.struct(F.lit(path).alias("path"), content.alias("content")))

    empty = F.lit("")
    files = F.array(
        when(c % 3 == 0, "composer.json", pick(COMPOSER, c)),
        when(c % 5 == 2, "api/composer.json", pick(COMPOSER, c + 1)),
        when(c % 4 <= 1, "package.json", pick(PACKAGE, div(c, 4))),
        when(c % 5 == 0, "requirements.txt", fill(pick(REQUIREMENTS, div(c, 5)), n=n)),
        when(c % 10 == 0, "pyproject.toml", F.lit('dependencies = ["Django"]')),
        when(c % 7 == 0, "docker-compose.yml", pick(COMPOSE, div(c, 7))),
        when(c % 2 == 0, "Dockerfile", F.lit("FROM scratch")),
        when(c % 6 == 1, ".env", pick(ENVS, div(c, 6))),
        when(c % 8 == 3, "application/config/database.php", pick(DATABASE_PHP, div(c, 8))),
        when(c % 9 == 4, "k8s/deploy.yaml", F.lit(K8S_YAML)),
        when(c % 9 == 5, "deploy/b.yaml", F.lit(K8S_YAML)),
        when(c % 9 == 5, "deploy/a.yml", F.lit("kind: none")),
        when(c % 10 == 6, "infra/main.tf", F.lit('provider "aws" {}')),
        when(c % 11 == 2, "system/core/CodeIgniter.php", fill(pick(CORE_PHP, div(c, 11)), n=n)),
        when(c % 13 == 3, "artisan", empty),
        when(c % 13 == 5, "spark", empty),
        when(c % 13 == 7, "manage.py", F.lit("import django")),
        when(c % 13 == 9, "go.mod", F.lit("module x\n")),
        when(c % 13 == 11, "pom.xml", F.lit("<a>spring-boot</a>")),
        when(c % 17 == 1, "serverless.yml", F.lit("service: x")),
        when(c % 19 == 1, ".aws/config", empty),
        when(c % 3 == 1, "composer.lock", fill(F.lit(LOCK), n=n)),
        when(c % 2 == 1, "src/index.js", empty),
        when(c % 4 == 1, "src/app.py", empty),
        when(c % 4 == 3, "vendor/x/package.json", pick(PACKAGE, c)),
    )
    return customers.select(
        F.concat(F.lit("c"), c.cast("string")).alias("project"), F.inline(F.array_compact(files))
    ).select(
        "project",
        "path",
        F.lit(False).alias("is_dir"),
        F.octet_length("content").cast("long").alias("size"),
        "content",
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding per line item."""
    items = spread(
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    )
    o, p, s, n = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    index = o + n * 5 + p
    rule = pick(FINDING_RULES, index)
    own = rule.startswith("DOCKER_") | rule.startswith("SEMGREP:")
    return items.select(
        skewed_project(o, 23).alias("project"),
        rule.alias("rule_id"),
        pick(FINDING_SEVERITIES, index + s % 3).alias("severity"),
        pick(FINDING_CATEGORIES, index).alias("category"),
        F.concat(F.lit("Title "), (index % len(FINDING_RULES)).cast("string")).alias("title"),
        F.concat(F.lit("src/f"), (p % 60).cast("string"), F.lit(".php")).alias("file"),
        ((n * 10 + s % 7) * (o % 5)).cast("int").alias("line"),
        F.when(s % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("code "), (s % 50).cast("string"))).alias("snippet"),
        F.concat(F.lit("Why "), (p % 3).cast("string")).alias("explanation"),
        F.when(p % 6 == 0, F.lit("")).otherwise(F.lit("Fix it.")).alias("recommendation"),
        F.when(own, F.lit("CWE-250")).otherwise(F.lit("")).alias("cwe"),
        F.when(own, F.lit("A05:2021 Security Misconfiguration")).otherwise(F.lit("")).alias("owasp"),
        # Part and order numbers make the order of findings complete; they may pass an int.
        p.cast("long").alias("phase"),
        (o * 1000 + n * 100 + s % 100).cast("long").alias("ord"),
    )


def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight diff lines per order; every second order continues the file before it."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    start = (o % 40 * 5 + 1).cast("string")
    target = F.when(o % 19 == 0, F.lit("+++ /dev/null")).otherwise(
        F.concat(F.when(o % 7 == 0, F.lit("+++ b/./src/f")).otherwise(F.lit("+++ b/src/f")), (c % 60).cast("string"), F.lit(".php"))
    )
    lines = F.array(
        F.lit("diff --git a/x b/x"),
        F.lit("--- a/x"),
        F.when(o % 2 == 0, target).otherwise(F.lit(" context")),
        F.concat(F.lit("@@ -1,2 +"), start, F.lit(","), (o % 4).cast("string"), F.lit(" @@ fn()")),
        F.lit("+added"),
        F.concat(F.lit("@@ -20 +"), (o % 90).cast("string"), F.lit(" @@")),
        F.lit("@@ broken"),
        F.concat(F.lit("@@ -5,2 +"), start, F.lit(",0 @@")),
    )
    return orders.select(
        skewed_project(o, 23).alias("project"), o.alias("o"), F.posexplode(lines).alias("i", "text")
    ).select("project", (F.col("o") * 10 + F.col("i")).alias("line_no"), "text")


def scan_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    o = F.col("o_orderkey")
    path = F.concat(
        F.lit("/srv/c"), F.when(F.col("o_custkey") % 3 == 0, F.lit(0)).otherwise(F.col("o_custkey")).cast("string")
    )
    total = F.floor(F.col("o_totalprice") / 5000).cast("long")
    score = (o % 101).cast("int")
    return orders.select(
        o.cast("string").alias("id"),
        path.alias("project"),
        path.alias("path"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("created_at"),
        F.lit("PHP").alias("language"),
        total.alias("total"),
        score.alias("security_score"),
        F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F").alias("security_grade"),
    )


def deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    p = F.col("l_partkey")
    return items.select(
        skewed_project(F.col("l_orderkey"), 23).alias("project"),
        F.lit("composer.lock").alias("source"),
        pick(ECOSYSTEMS, p).alias("ecosystem"),
        F.concat(F.lit("pkg-"), p.cast("string")).alias("name"),
        F.concat_ws(
            ".", (F.col("l_suppkey") % 4).cast("string"), (F.col("l_linenumber") % 3).cast("string"), F.lit("0")
        ).alias("version"),
    )


def advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    p = F.col("p_partkey")
    return parts.select(
        F.concat(F.lit("ADV-"), p.cast("string")).alias("id"),
        pick(ECOSYSTEMS, p).alias("ecosystem"),
        F.concat(F.lit("pkg-"), p.cast("string")).alias("name"),
        F.concat_ws(".", (F.col("p_size") % 4).cast("string"), (p % 3).cast("string"), F.lit("0")).alias("version"),
        pick(ADVISORY_SEVERITIES, F.col("p_size")).alias("severity"),
        F.when(p % 5 == 0, F.lit("")).otherwise(F.col("p_name")).alias("summary"),
    )


REPORT_TEMPLATES = {
    "semgrep": SEMGREP_REPORT,
    "bandit": BANDIT_REPORT,
    "gosec": GOSEC_REPORT,
    "eslint": ESLINT_REPORT,
    "phpstan": PHPSTAN_REPORT,
}


def scanner_reports(spark: SparkSession, sf_dir: str, engine: str) -> DataFrame:
    """One report document per customer."""
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    c = F.col("c_custkey")
    return as_table(
        customers.select(
            F.concat(F.lit("c"), c.cast("string")).alias("project"),
            F.lit("/srv/app").alias("root"),
            fill(
                F.lit(REPORT_TEMPLATES[engine]),
                n=c,
                d=c % 10,
                s=pick(REPORT_SEVERITIES, c),
                c=pick(REPORT_CATEGORIES, c),
            ).alias("payload"),
        )
    )


def file_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path-only files: those of the source corpus plus the pages' addresses as paths."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    p = F.col("page_id")
    addresses = pages.select(
        skewed_project(p, 41).alias("project"),
        F.concat(F.regexp_replace("url", "^https?://", ""), pick(EXTS, p)).alias("path"),
        F.lit(False).alias("is_dir"),
    )
    return source_files(spark, sf_dir).select("project", "path", "is_dir").unionByName(addresses)


