"""Whole scans of small projects with known findings."""

import json
import os

import pytest
from pyspark.sql import functions as F

from faultlens.functions import logtext
from faultlens.operators import codelines, configscan, detect, manifests
from faultlens.plans import project_scan
from faultlens.sources import baselines, lockfiles, scanners, tree

STRIPE = "sk_live_" + "a1" * 12

SHOP = {
    "composer.json": '{\n  "require": {\n    "php": ">=5.6",\n    "vendor/kit": "*"\n  }\n}\n',
    "application/config/config.php": "<?php\nini_set('display_errors', 1);\n$config['token_secret'] = '';\n$api_key = 'q8w7e6r5t4';\n",
    "application/models/Order.php": (
        "<?php\n// key below\n$stripe = '" + STRIPE + "';\n/*\n * eval($x);\n */\n"
        '$q = "SELECT * FROM orders WHERE id=" . $id;\n'
        "try { run();\n} catch (Exception $e) {\n  // ignored\n}\n"
    ),
    "application/controllers/Page.php": "<?php\necho $_GET['q'];\ninclude $_GET['page'];\n$u->first()->name;\n",
    "tests/unit/KeyTest.php": "<?php\n$password = 'hunter2-real';\n",
    "vendor/lib/x.php": "<?php eval($a);\n",
    "assets/js/app.js": "eval(x)\n",
    "js/app.min.js": "eval(x)\n",
    "system/core/CodeIgniter.php": "<?php const CI_VERSION = '3.1.11'; eval($x);\n",
    "system/helpers/h.php": "<?php eval($x);\n",
    "Dockerfile": "FROM node:latest\n# USER root\nUSER root\nENV API_KEY=abcd1234\n",
    ".env": "APP_DEBUG=true\nDB_PASSWORD=realsecret\nAPI_TOKEN=changeme\n",
    ".env.example": "DB_PASSWORD=realsecret\n",
    "docker-compose.yml": 'ports:\n  - "3306:3306"\n  - "127.0.0.1:5432:5432"\n',
    "k8s/pod.yaml": "apiVersion: v1\nkind: Pod\nprivileged: true\n",
    "conf/nginx.conf": "server_tokens on;\nautoindex on;\nssl_protocols TLSv1 TLSv1.2;\n",
    "web/.htaccess": "Options +Indexes\n",
}

EXPECTED = {
    ("composer.json", 3, "DEP_EOL_PHP"),
    ("composer.json", 4, "DEP_UNPINNED"),
    ("application/config/config.php", 2, "CFG_DISPLAY_ERRORS"),
    ("application/config/config.php", 4, "SEC_HARDCODED_CREDENTIAL"),
    ("application/models/Order.php", 3, "SEC_TOKEN"),
    ("application/models/Order.php", 7, "PERF_SELECT_STAR"),
    ("application/models/Order.php", 7, "DB_RAW_SQL_CONCAT"),
    ("application/models/Order.php", 9, "ERR_EMPTY_CATCH"),
    ("application/controllers/Page.php", 2, "PHP_SUPERGLOBAL_INPUT"),
    ("application/controllers/Page.php", 2, "XSS_REFLECTED"),
    ("application/controllers/Page.php", 3, "PHP_SUPERGLOBAL_INPUT"),
    ("application/controllers/Page.php", 3, "SEC_PATH_TRAVERSAL"),
    ("application/controllers/Page.php", 4, "NPE_NULLABLE_CHAIN"),
    ("Dockerfile", 1, "DOCKER_LATEST_TAG"),
    ("Dockerfile", 3, "DOCKER_USER_ROOT"),
    ("Dockerfile", 4, "DOCKER_SECRET_ENV"),
    (".env", 1, "ENV_APP_DEBUG"),
    (".env", 2, "ENV_SECRET_COMMITTED"),
    ("docker-compose.yml", 2, "COMPOSE_DB_PORT_EXPOSED"),
    ("k8s/pod.yaml", 3, "K8S_PRIVILEGED"),
    ("conf/nginx.conf", 1, "WEB_SERVER_TOKENS"),
    ("conf/nginx.conf", 2, "NGINX_AUTOINDEX"),
    ("conf/nginx.conf", 3, "WEB_OLD_TLS"),
    ("web/.htaccess", 1, "APACHE_INDEXES"),
}


def places(findings):
    rows = findings.select("file", "line", "rule_id").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def write_tree(root, contents):
    for path, text in contents.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w", encoding="utf-8", newline="") as f:
            f.write(text)


def test_static_findings(spark, make_files):
    assert places(project_scan.static_findings(make_files(SHOP))) == EXPECTED


def test_scan_from_tree(spark, tmp_path):
    """The same findings from disk, also through the stored table with its partitions."""
    root = str(tmp_path / "shop")
    write_tree(root, SHOP)
    os.makedirs(os.path.join(root, "empty/dir"))
    files = tree.read_tree(spark, root)
    stored = str(tmp_path / "files")
    tree.write_files(files, stored)
    table = tree.read_files(spark, stored)
    names = {r.path for r in table.collect()}
    assert {".env", "empty", "empty/dir", "system/helpers/h.php"} <= names
    assert not any(n.startswith("vendor") for n in names)
    assert places(project_scan.static_findings(table)) == EXPECTED
    with pytest.raises(FileNotFoundError):
        tree.read_tree(spark, root + "-missing")


def test_summary(spark, make_files):
    result = project_scan.scan(make_files(SHOP), project_scan.ScanOptions(fail_on="High"))
    row = result.summary.first()
    # 5 source files outside skipped directories, 6 config files with a rule set.
    assert row.files_scanned == 4 + 6
    assert row.total == len(EXPECTED)
    assert row.critical == 1
    assert row.security_rating == "E"
    assert row.security_score <= 79
    gate = result.gate.first()
    assert gate.fail_count == row.critical + row.high and not gate.passed


def test_options(spark, make_files):
    files = make_files(SHOP)
    diff = spark.createDataFrame(
        [
            ("p", i, t)
            for i, t in enumerate(
                ["+++ b/Dockerfile", "@@ -1,0 +3,2 @@", "+++ b/.env", "@@ -1 +1 @@", "+++ /dev/null", "@@ -1,3 +0,0 @@", "+++ b/composer.json"]
            )
        ],
        "project string, line_no long, text string",
    )
    options = project_scan.ScanOptions(diff_lines=diff, disabled_rules=["DOCKER_SECRET_ENV"])
    assert places(project_scan.scan(files, options).findings) == {
        ("Dockerfile", 3, "DOCKER_USER_ROOT"),
        (".env", 1, "ENV_APP_DEBUG"),
    }
    narrowed = project_scan.ScanOptions(categories=["Infrastructure"], minimum_severity="HIGH")
    found = project_scan.scan(files, narrowed).findings
    assert {p[2] for p in places(found)} == {
        "DOCKER_SECRET_ENV", "ENV_SECRET_COMMITTED", "K8S_PRIVILEGED",
    }


def test_long_lines_and_placeholders(spark, make_files):
    files = make_files(
        {
            "a.js": "eval(x) " + "y" * 500 + "\ncatch (e) {" + " " * 600 + "}\n",
            "b.js": "password = 'changeme'\npassword = 'abc'\npassword: 'two words here'\nsecret = '$ref1234'\n",
            "c.js": "-----BEGIN RSA PRIVATE KEY-----\n",
            "x.test.js": "-----BEGIN RSA PRIVATE KEY-----\n",
        }
    )
    got = places(detect.code_findings(codelines.code_files(files)))
    assert got == {("a.js", 1, "JS_EVAL"), ("a.js", 2, "ERR_EMPTY_CATCH"), ("c.js", 1, "SEC_TOKEN")}


def test_manifest_versions(spark, make_files):
    files = make_files(
        {
            "a/composer.json": '{"require": {"php": "^7.4"}}',
            "b/composer.json": '{"require": {"php": "~7.3"}}',
            "c/package.json": '{"dependencies": {"x": "latest"}}',
        }
    )
    assert places(manifests.manifest_findings(files)) == {
        ("b/composer.json", 1, "DEP_EOL_PHP"),
        ("c/package.json", 1, "DEP_UNPINNED"),
    }


def test_config_kinds(spark, make_files):
    files = make_files(
        {"svc.dockerfile": "USER root", "values.yml": "privileged: true", "compose.yaml": "privileged: true", ".env.dist": "DEBUG=1"}
    )
    assert places(configscan.config_findings(files)) == {
        ("svc.dockerfile", 1, "DOCKER_USER_ROOT"),
        ("compose.yaml", 1, "COMPOSE_PRIVILEGED"),
    }


def test_framework_core(spark, make_files):
    kept = {r.path for r in codelines.without_framework_core(make_files(SHOP)).collect()}
    assert "system/helpers/h.php" not in kept and len(kept) < len(SHOP)


def test_nothing_is_cut(spark, make_files, tmp_path):
    """Long files, long lines, long reports and long lock files are read to their end."""
    filler = "// filler text of a comment\n"
    files = make_files(
        {
            "long.php": filler * (3 * 1024 * 1024 // len(filler)) + "eval($x);\n",
            "line.php": "$a = '" + "x" * 5000 + "'; eval($x);\n",
            "big/Dockerfile": "# x\n" * 200_000 + "USER root\n",
            "package-lock.json": json.dumps(
                {"packages": {f"node_modules/{'p' * 100}{i}": {"version": "1.0.0"} for i in range(30_000)}}
            ),
        }
    )
    found = {(r.file, r.rule_id) for r in project_scan.static_findings(files).collect()}
    assert {("long.php", "PHP_DANGEROUS_EXEC"), ("line.php", "PHP_DANGEROUS_EXEC"), ("big/Dockerfile", "DOCKER_USER_ROOT")} <= found
    assert lockfiles.dependencies(files).count() == 30_000
    report = json.dumps({"results": [{"test_id": f"B{i}", "line_number": i} for i in range(1500)]})
    reports = spark.createDataFrame([("p", "", report)], "project string, root string, payload string")
    assert scanners.bandit_findings(reports).count() == 1500
    assert scanners.bandit_findings(reports, limit=1000).count() == 1000
    (tmp_path / "big.lock").write_text("x" * 4_000_000)
    row = tree.read_tree(spark, str(tmp_path)).first()
    assert (row.size, len(row.content)) == (4_000_000, 4_000_000)


def test_long_messages_that_differ_late_are_two_groups(spark):
    rows = [("a" * 200 + " x",), ("a" * 200 + " y",)]
    messages = spark.createDataFrame(rows, "m string")
    assert messages.select(logtext.signature(F.col("m"))).distinct().count() == 2


def test_no_option_drops_nothing(spark, make_files):
    deps = spark.createDataFrame([("p", "l", "npm", "a", "1")], "project string, source string, ecosystem string, name string, version string")
    advisories = spark.createDataFrame(
        [("X-1", "npm", "a", "1", "MODERATE", "s")], "id string, ecosystem string, name string, version string, severity string, summary string"
    )
    result = project_scan.scan(make_files({"a.txt": "x"}), deps=deps, advisories=advisories)
    assert [r.rule_id for r in result.findings.collect()] == ["DEP_CVE"]


def test_a_baseline_leaves_other_projects(spark, make_files, tmp_path):
    path = str(tmp_path / "baseline")
    for project in ("p1", "p2", "p1"):
        found = project_scan.static_findings(make_files({"a.php": "eval($x);"}, project))
        baselines.write_baseline(found, path)
    assert sorted(r.project for r in baselines.read_baseline(spark, path).collect()) == ["p1", "p2"]


def test_uris_and_listings_equal_the_walk(spark, tmp_path):
    root = tmp_path / "tree"
    for path, body in {**SHOP, "node_modules/x/a.js": "x", "a b/ä.php": "y", "System/core/CodeIgniter.php": "z"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(body)
    columns = ["project", "path", "is_dir", "size", "content", "in_core"]

    def rows(frame):
        return sorted(tuple(r) for r in frame.select(*columns).fillna("", ["content"]).collect())

    walked = rows(tree.read_tree(spark, str(root), "p"))
    assert rows(tree.read_tree(spark, root.as_uri(), "p")) == walked
    files = [("p", str(f.relative_to(root)), f.stat().st_size, f.read_text()) for f in root.rglob("*") if f.is_file()]
    assert rows(tree.tree_rows(spark.createDataFrame(files, "project string, path string, size long, content string"))) == walked


def test_walk_spreads_a_tree_that_branches_deep_down(spark, tmp_path):
    for i in range(20):
        for j in range(3):
            where = tmp_path / "src" / "main" / f"m{i}" / f"d{j}"
            where.mkdir(parents=True)
            (where / "a.php").write_text("x")
    parts = tree.plan_walk([("p", str(tmp_path))], 4)
    below = [unit for part in parts for unit in part.dirs if unit[-1]]
    assert len(parts) == 4 and len(below) >= 4 * tree.DIRS_PER_TASK
    assert all(sum(unit[-1] for unit in part.dirs) >= tree.DIRS_PER_TASK for part in parts)
    entries = tree.walk(spark, [("p", str(tmp_path))], 4)
    assert entries.rdd.getNumPartitions() == 4
    rows = sorted(r.path for r in entries.collect())
    assert rows == sorted(str(f.relative_to(tmp_path)) for f in tmp_path.rglob("*"))


def test_walk_of_small_and_narrow_trees(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    deep = tmp_path / "deep" / "/".join("abcdefgh")
    deep.mkdir(parents=True)
    (deep / "f.py").write_text("x")
    roots = [("e", str(tmp_path / "empty")), ("d", str(tmp_path / "deep")), ("gone", str(tmp_path / "gone"))]
    rows = tree.walk(spark, roots, 3).where("not is_dir").collect()
    assert [(r.project, r.path) for r in rows] == [("d", "a/b/c/d/e/f/g/h/f.py")]
    assert tree.walk(spark, [], 3).count() == 0


def test_trees_written_are_those_read(spark, tmp_path):
    files = spark.createDataFrame(
        [("p", "a/ä.php", "é\r\n"), ("p", "b", None), ("q", ".env", "K=1")], "project string, path string, content string"
    )
    assert tree.write_trees(files, f"file:{tmp_path}") == 3
    assert tree.walk(spark, [("all", f"file:{tmp_path}")]).where("not is_dir").count() == 3
    got = tree.read_tree(spark, str(tmp_path), "all").where("not is_dir")
    assert sorted((r.path, r.content) for r in got.collect()) == [("p/a/ä.php", "é\r\n"), ("p/b", ""), ("q/.env", "K=1")]
    with pytest.raises(Exception, match="path leaves its tree"):
        tree.write_trees(spark.createDataFrame([("p", "../x", "y")], "project string, path string, content string"), str(tmp_path))
