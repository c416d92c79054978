import json
import random

import pytest
from pyspark.sql import functions as F

from faultlens.operators import compliance, dependencies, diffscope, grouping, insights, technology
from faultlens.operators import findings as fo
from faultlens.operators.windows import carry_forward
from faultlens.plans import project_scan
from faultlens.schemas import FINDINGS
from faultlens.sources import baselines, exports, history, lockfiles, scanners


def finding(rule="R", severity="High", category="Security", file="a.php", line=1, snippet="code", title="T", ord=0, **more):
    base = dict(
        project="p", rule_id=rule, severity=severity, category=category, title=title, file=file, line=line, snippet=snippet,
        explanation="why", recommendation="fix", cwe="", owasp="", phase=0, ord=ord,
    )
    base.update(more)
    return tuple(base[f.name] for f in FINDINGS.fields)


@pytest.fixture()
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, FINDINGS)


@pytest.mark.parametrize(
    "files, severities, low, high",
    [(100, [], 100, 100), (100000, ["Critical"], 1, 79), (1449, ["Medium"] * 6000, 1, 30)],
)
def test_score_bounds(spark, frame, files, severities, low, high):
    rows = frame([finding(severity=s) for s in severities])
    scanned = spark.createDataFrame([("p", files)], "project string, files_scanned long")
    assert low <= fo.summary(rows, scanned).first().score <= high


def test_score_falls_with_density(spark, frame):
    def score(files, n):
        scanned = spark.createDataFrame([("p", files)], "project string, files_scanned long")
        return fo.summary(frame([finding() for _ in range(n)]), scanned).first().score

    assert score(2000, 2) > score(5, 2)
    assert score(100, 50) < score(100, 1)


def test_baseline_survives_moved_lines(frame):
    old = frame([finding(line=3), finding(rule="S", snippet="", title="CVE")])
    now = frame([finding(line=42), finding(rule="S", snippet="", title="CVE"), finding(rule="N")])
    kept = fo.suppress_known(now, baselines.baseline_of(old)).collect()
    assert [r.rule_id for r in kept] == ["N"]


def test_a_stored_baseline_is_not_shuffled(spark, frame, tmp_path):
    old = frame([finding(line=3), finding(rule="S", snippet="", title="CVE")])
    now = frame([finding(line=42), finding(rule="S", snippet="", title="CVE"), finding(rule="N")])
    baselines.write_baseline_table(old, "accepted_before", str(tmp_path / "table"), 16)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = fo.suppress_known(now, baselines.read_baseline_table(spark, "accepted_before"))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert [r.rule_id for r in kept.collect()] == ["N"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sql("DROP TABLE accepted_before")
    assert plan.count("Exchange ") == 1 and "Bucketed: true" in plan and "hashpartitioning(project" in plan
    # The table's side is the last one of the join.
    assert "Exchange " not in plan[plan.index("FileScan parquet"):]


def test_a_baseline_tells_lines_apart_that_differ_after_the_snippet(make_files):
    long = "x" * 200

    def found(a, b):
        files = make_files({"a.py": f"x = eval('{long}{a}')\n", "Dockerfile": f"ENV API_KEY={long}{b}\n"})
        return project_scan.static_findings(files)

    old, now = found("1", "1"), found("2", "2")
    both = fo.merge(old, now)
    assert both.select("file", "snippet").distinct().count() == 2 == old.count()
    assert fo.suppress_known(now, baselines.baseline_of(old)).count() == 2
    assert fo.suppress_known(now, baselines.baseline_of(both)).count() == 0
    assert baselines.baseline_of(both).count() == 4
    # Whole snippets keep the fingerprints that stored baselines have.
    whole = found("", "").withColumn("snippet", F.lit("s")).withColumn("identity", F.lit(None).cast("string"))
    assert fo.suppress_known(whole, whole.select("project", fo.fingerprint().alias("fingerprint"))).count() == 0


def test_a_baseline_tells_cut_scanner_texts_apart(spark):
    def found(engine, payload):
        return scanners.ENGINES[engine](spark.createDataFrame([("p", "/r", json.dumps(payload))], "project string, root string, payload string"))

    for engine, payload in {
        "eslint": lambda x: [{"filePath": "/r/a.js", "messages": [{"ruleId": "r", "message": "m" * 900 + x, "line": 1, "severity": 2}]}],
        "gosec": lambda x: {"Issues": [{"rule_id": "G", "details": "d", "file": "/r/a.go", "code": "c" * 900 + x, "line": "1", "severity": "LOW"}]},
        "bandit": lambda x: {"results": [{"test_id": "B", "issue_text": "t", "filename": "/r/a.py", "code": "1 " + "c" * 900 + x, "line_number": 1}]},
    }.items():
        old, now = found(engine, payload("1")), found(engine, payload("2"))
        assert now.count() == 1 and now.select("title", "snippet").exceptAll(old.select("title", "snippet")).count() == 0
        assert fo.suppress_known(now, baselines.baseline_of(old)).count() == 1
        assert fo.suppress_known(now, baselines.baseline_of(now)).count() == 0


def test_compliance(spark, frame):
    rows = fo.enrich(
        frame([finding("DB_RAW_SQL_CONCAT"), finding("DB_RAW_SQL_CONCAT"), finding("SEC_TOKEN", "Critical"), finding("PERF_SELECT_STAR")])
    )
    projects = rows.select("project").distinct()
    owasp = {r.code: (r["count"], r.status) for r in compliance.owasp_report(rows, projects).collect()}
    assert len(owasp) == 10
    assert owasp["A03"] == (2, "Issues found")
    assert owasp["A07"][1] == "Issues found"
    assert owasp["A04"][1] == "Not assessed"
    assert owasp["A10"] == (0, "No issues detected")
    area = {r.code: r.status for r in compliance.framework_report(rows, projects).collect()}
    assert area["A03"] == "Action needed" and len(area) == 9
    top = compliance.cwe_breakdown(rows).orderBy(F.col("count").desc(), "cwe").first()
    assert (top.cwe, top["count"]) == ("CWE-89", 2)


def test_group_takes_first_texts_and_worst_severity(frame):
    rows = frame(
        [finding(severity="Low", file="a", title="late"), finding(severity="Critical", file="z", title="first")]
        + [finding(severity="Low", file="b", line=i) for i in range(150)]
    )
    group = grouping.finding_groups(fo.enrich(rows)).first()
    assert (group.severity, group.title, group["count"], group.extra_count) == ("Critical", "first", 152, 52)
    assert grouping.occurrences(rows).count() == 100


def test_changed_lines_against_brute_force(spark, frame):
    rng = random.Random(3)
    ranges, rows = [], []
    for _ in range(120):
        start = rng.randint(1, 3000)
        ranges.append(("p", f"f{rng.randint(0, 3)}", start, start + rng.choice([0, 1, 5, 255, 256, 511, 700, 1500])))
    for i in range(1500):
        rows.append(finding(file=f"f{rng.randint(0, 5)}", line=rng.choice([0, rng.randint(1, 5000)]), ord=i))
    files = [("p", f"f{i}", i == 3) for i in range(5)]
    changed = spark.createDataFrame(files, "project string, file string, all boolean")
    spans = spark.createDataFrame(ranges, "project string, file string, start int, end int")
    got = {r.ord for r in fo.on_changed_lines(frame(rows), changed, spans).collect()}
    names = {f: whole for _, f, whole in files}
    want = {
        r[-1] for r in rows
        if r[5] in names and (names[r[5]] or r[6] <= 0 or any(f == r[5] and s <= r[6] <= e for _, f, s, e in ranges))
    }
    assert got == want


def test_diff_ranges(spark):
    text = (
        "diff --git a/foo.php b/foo.php\n--- a/foo.php\n+++ b/foo.php\n@@ -10,0 +11,2 @@\n+echo 1;\n+echo 2;\n@@ -20 +22 @@\n"
        "-old\n+new\n--- /dev/null\n+++ b/new.js\n@@ -0,0 +1,3 @@\n+a\n+b\n+c\n--- a/gone.php\n+++ /dev/null\n@@ -1,3 +0,0 @@\n-a"
    )
    lines = spark.createDataFrame(
        [("p", i, t) for i, t in enumerate(text.split("\n"))], "project string, line_no long, text string"
    )
    files, ranges = diffscope.changed_lines(lines)
    assert {r.file for r in files.collect()} == {"foo.php", "new.js"}
    assert {tuple(r)[1:] for r in ranges.collect()} == {("foo.php", 11, 12), ("foo.php", 22, 22), ("new.js", 1, 3)}


def test_carry_forward_over_buckets(spark):
    rng = random.Random(5)
    rows = [("k%d" % (i % 3), i, rng.choice([None, None, None, f"v{i}"])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, n long, v string")
    got = {(r.k, r.n): r.out for r in carry_forward(df, ["k"], ["n"], "v", F.floor(F.col("n") / 7), "out").collect()}
    last = {}
    for k, n, v in rows:
        last[k] = v or last.get(k)
        assert got[(k, n)] == last[k]


def test_exports(spark, frame):
    rows = fo.enrich(frame([finding("SEC_TOKEN", "Critical"), finding("PERF_SELECT_STAR", "Medium", "Performance", line=0, snippet="")]))
    scanned = spark.createDataFrame([("p", 10)], "project string, files_scanned long")
    sarif = json.loads(exports.sarif_document(exports.sarif_rows(rows).collect()))
    run = sarif["runs"][0]
    assert sarif["version"] == "2.1.0"
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["SEC_TOKEN", "PERF_SELECT_STAR"]
    assert run["tool"]["driver"]["rules"][0]["properties"]["security-severity"] == "9.5"
    assert [r["level"] for r in run["results"]] == ["error", "warning"]
    assert "region" not in run["results"][1]["locations"][0]["physicalLocation"]
    doc = json.loads(exports.json_document(exports.json_rows(rows, fo.summary(rows, scanned)).collect()))
    assert doc["summary"]["total"] == 2 and doc["findings"][0]["cwe"] == "CWE-798"
    assert "snippet" not in doc["findings"][1]
    assert [r.Severity for r in exports.csv_rows(rows).collect()] == ["Critical", "Medium"]
    att = json.loads(exports.attestations(rows, scanned, gate=fo.gate(rows, scanned, "high")).first().document)
    assert att["findings"] == {"Critical": 1, "Medium": 1}
    assert att["gate"] == {"threshold": "high", "fail_count": 1, "passed": False}
    assert "files_changed" not in att


def test_large_exports_keep_their_order(spark, frame):
    rows = frame([finding(file=f"f{i:04}", line=i) for i in range(3000)])
    doc = json.loads(exports.sarif_document(exports.sarif_rows(rows.repartition(7)).collect()))["runs"][0]
    uris = [r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for r in doc["results"]]
    assert uris == [f"f{i:04}" for i in range(3000)] and len(doc["tool"]["driver"]["rules"]) == 1
    scanned = spark.createDataFrame([("p", 1), ("empty", 1)], "project string, files_scanned long")
    parts = exports.json_rows(rows, fo.summary(rows, scanned)).collect()
    assert [f["file"] for f in json.loads(exports.json_document([r for r in parts if r.project == "p"]))["findings"]] == uris
    assert json.loads(exports.json_document([r for r in parts if r.project == "empty"]))["findings"] == []


REPORTS = {
    "semgrep": (
        '{"results": [{"check_id": "php.lang.security.echoed", "path": "src/v.php", "start": {"line": 42}, "extra": {"message": "XSS.\\nmore", '
        '"severity": "ERROR", "lines": " echo 1;", "metadata": {"cwe": ["CWE-79: XSS"], "owasp": ["A03:2021 - Injection"], "category": "security"}}},'
        '{"check_id": "perf.loop", "path": "u.php", "start": {"line": 10}, "extra": {"message": "Slow.", "severity": "WARNING", "lines": "for", '
        '"metadata": {"cwe": "CWE-1050", "category": "performance"}}}]}',
        [("SEMGREP:echoed", "High", "Security", "src/v.php", 42, "CWE-79"), ("SEMGREP:loop", "Medium", "Performance", "u.php", 10, "CWE-1050")],
    ),
    "bandit": (
        'warn\n{"results": [{"filename": "/proj/app/v.py", "issue_severity": "HIGH", "issue_text": "shell", "test_id": "B602", "line_number": 42, '
        '"code": "41 import os\\n42 call(cmd)\\n", "issue_cwe": {"id": 78}}]}',
        [("BANDIT:B602", "High", "Security", "app/v.py", 42, "CWE-78")],
    ),
    "gosec": (
        '{"Issues": [{"severity": "MEDIUM", "rule_id": "G401", "details": "weak", "file": "/proj/hash.go", "code": "7: h", "line": "7-9", "cwe": {"id": "327"}}]}',
        [("GOSEC:G401", "Medium", "Security", "hash.go", 7, "CWE-327")],
    ),
    "eslint": (
        '[{"filePath": "/proj/a.js", "messages": [{"ruleId": null, "severity": 2, "message": "bad", "line": 3}]}]',
        [("ESLINT:parse-error", "Medium", "Error Handling", "a.js", 3, "")],
    ),
    "phpstan": (
        '{"files": {"/proj/a.php": {"messages": [{"message": "undefined", "line": 5, "identifier": "variable.undefined"}]}}}',
        [("PHPSTAN:variable.undefined", "Medium", "Error Handling", "a.php", 5, "")],
    ),
}


@pytest.mark.parametrize("engine", sorted(REPORTS))
def test_scanner_reports(spark, engine):
    payload, want = REPORTS[engine]
    reports = spark.createDataFrame([("p", "/proj", payload), ("p", "/proj", "")], "project string, root string, payload string")
    rows = scanners.ENGINES[engine](reports).orderBy("ord").collect()
    assert [(r.rule_id, r.severity, r.category, r.file, r.line, r.cwe) for r in rows] == want
    if engine == "bandit":
        assert rows[0].snippet == "call(cmd)"


def test_dependencies(spark, make_files):
    files = make_files(
        {
            "composer.lock": '{"packages": [{"name": "vuln/pkg", "version": "1.0.0"}], "packages-dev": [{"name": "safe/pkg", "version": "2.0.0"}]}',
            "requirements.txt": "Django==2.2.0\nrequests>=2.0\n# comment\nflask==1.0.0\n",
            "package-lock.json": '{"packages": {"": {"version": "1"}, "node_modules/a/node_modules/b": {"version": "3.0.0"}}}',
            "go.mod": "module x\nrequire (\n\tgithub.com/a/b v1.2.3 // indirect\n)\n",
        }
    )
    deps = lockfiles.dependencies(files)
    assert {(r.ecosystem, r.name, r.version) for r in deps.collect()} == {
        ("Packagist", "vuln/pkg", "1.0.0"), ("Packagist", "safe/pkg", "2.0.0"), ("PyPI", "Django", "2.2.0"), ("PyPI", "flask", "1.0.0"),
        ("npm", "b", "3.0.0"), ("Go", "github.com/a/b", "v1.2.3"),
    }
    advisories = spark.createDataFrame(
        [("GHSA-1", "Packagist", "vuln/pkg", "1.0.0", "CRITICAL", "Remote code")],
        "id string, ecosystem string, name string, version string, severity string, summary string",
    )
    found = dependencies.dependency_findings(deps, advisories).collect()
    assert [(f.severity, f.explanation, f.line) for f in found] == [("Critical", "Remote code", 0)]


def test_technologies(spark, make_files):
    files = make_files(
        {
            "composer.json": '{"require": {"php": "8.1"}}',
            "system/core/CodeIgniter.php": "const CI_VERSION = '3.1.11';",
            "application/config/database.php": "'dbdriver' => 'mysqli'",
            ".env": "DB=mysql",
            "Dockerfile": "FROM x",
        }
    )
    got = {r.name: r for r in technology.technologies(files).collect()}
    assert set(got) == {"PHP", "CodeIgniter 3", "MySQL", "Docker"}
    assert (got["CodeIgniter 3"].version, got["CodeIgniter 3"].confidence) == ("3.1.11", "High")
    assert got["MySQL"].evidence == ["dbdriver mysqli in database.php", "mysql referenced in .env"]


def test_insights(spark, frame):
    rows = fo.enrich(frame([finding("SEC_TOKEN", "Critical", title="Key"), finding("DB_RAW_SQL_CONCAT", "High", "Database", title="SQL")]))
    runtime = spark.createDataFrame(
        [("p", "E_ERROR", "r.php", 5, 9, "t", "boom", "fatal")],
        "project string, type string, file string, line int, count long, last_seen string, last_message string, severity string",
    )
    logs = spark.createDataFrame(
        [("p", "sig", "Lock wait", "Database", "ERROR", 250, "", "", "Long transactions.")],
        "project string, signature string, sample string, category string, level string, count long, first_seen string, last_seen string, cause string",
    )
    problems = insights.problem_list(rows, runtime, logs)
    got = insights.insights(problems).orderBy("insight").collect()
    assert [(g.severity, g.title) for g in got] == [("Critical", "E_ERROR"), ("Critical", "Key"), ("High", "Lock wait"), ("High", "SQL")]
    assert got[2].root_cause == "Long transactions." and "observed 250 times" in got[2].problem
    assert "?" in got[3].fix_example


def test_history(spark):
    rows = [("1", "/a", "2024-01-30", 5), ("2", "/a", "2024-02-01", 9), ("3", "/a", "2024-02-03", 4), ("4", "/b", "2024-01-01", 7)]
    scans = spark.createDataFrame(rows, "id string, path string, created_at string, total long")
    got = {r.id: r.new_since for r in history.replay_new_since(scans).collect()}
    assert got == {"1": 0, "2": 4, "3": 0, "4": 0}
    new = spark.createDataFrame([("5", "/a", "2024-03-01", 10, 0)], "id string, path string, created_at string, total long, new_since long")
    assert history.with_new_since(new, scans).first().new_since == 6


def test_appends_read_the_kept_rows_only(spark, tmp_path):
    out = str(tmp_path / "history")
    columns = "id string, path string, created_at string, total long, other int"

    def rows(*values):
        return spark.createDataFrame([(*v, 1) for v in values], columns)

    def stored():
        return {r.id: (r.path, r.new_since) for r in history.appended_scans(spark, out).collect()}

    def kept():
        return {r.path: (r.scans, r.total, r.previous_total, r.new_since) for r in history.kept_scans(spark, out).collect()}

    history.append_scans(rows(("1", "/a", "2024-01-01", 5), ("2", "/a", "2024-01-02", 9), ("3", None, "2024-01-01", 2)), out, 0)
    assert stored() == {"1": ("/a", 0), "2": ("/a", 4), "3": ("", 0)} and kept() == {"/a": (2, 9, 5, 4), "": (1, 2, None, 0)}
    batch = rows(("4", "/a", "2024-03-01", 12), ("5", "/b", None, 7), ("6", "", "2024-01-01", 3))
    for _ in range(2):  # run again after a failure
        history.append_scans(batch, out, 1)
        assert stored() == {"1": ("/a", 0), "2": ("/a", 4), "3": ("", 0), "4": ("/a", 3), "5": ("/b", 0), "6": ("", 1)}
        assert kept() == {"/a": (3, 12, 9, 3), "/b": (1, 7, None, 0), "": (2, 3, 2, 1)}
    files = history.filled_new_since(spark.read.parquet(f"{out}/staged/batch=1"), out, 2).inputFiles()
    assert files and all("/kept/" in f or "/staged/batch=1/" in f for f in files)
    # A record that comes late counts; only its own new_since waits for the replay.
    history.append_scans(rows(("7", "/a", "2024-02-01", 20)), out, 2)
    assert kept()["/a"] == (4, 12, 20, 0) and stored()["7"] == ("/a", 0)
    history.append_scans(rows(("8", "/a", "2024-03-01", 1)).limit(0), out, 3)
    assert kept()["/a"] == (4, 12, 20, 0) and len(stored()) == 7


def test_spans_merge_and_touch(spark):
    pieces = [("p", "f", 1, 5), ("p", "f", 6, 6), ("p", "f", 8, 20), ("p", "f", 9, 10), ("p", "f", 4000, 9000), ("q", "f", 3, 2), ("p", "g", 2, 2)]
    ranges = spark.createDataFrame(pieces, "project string, file string, start int, end int")
    files = spark.createDataFrame([("p", "f"), ("p", "g"), ("q", "f")], "project string, file string")
    got = {(r.project, r.file, r.bucket): [tuple(s) for s in r.spans] for r in diffscope.spans_of(files, ranges).collect()}
    assert got == {
        ("p", "f", -1): [], ("p", "g", -1): [], ("q", "f", -1): [], ("p", "g", 0): [(2, 2)],
        ("p", "f", 0): [(1, 6), (8, 20), (4000, 4095)], ("p", "f", 1): [(4096, 8191)], ("p", "f", 2): [(8192, 9000)],
    }


def test_changed_lines_plan(spark, frame, tmp_path):
    """Findings are scanned and shuffled once; the diff twice, for its files and what they carry."""
    path = str(tmp_path / "diff")
    spark.createDataFrame([("p", 0, "+++ b/a.php"), ("p", 1, "@@ -1 +2,3 @@")], "project string, line_no long, text string").write.parquet(path)
    frame([finding(file="a.php", line=3, ord=1), finding(file="a.php", line=9, ord=2)]).write.parquet(str(tmp_path / "found"))
    kept = fo.on_changed_spans(spark.read.parquet(str(tmp_path / "found")), diffscope.changed_spans(spark.read.parquet(path)))
    assert [r.ord for r in kept.collect()] == [1]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fo.on_changed_spans(spark.read.parquet(str(tmp_path / "found")), diffscope.changed_spans(spark.read.parquet(path)))
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert text.count("FileScan parquet") == 3 and text.count("- Exchange ") <= 6


def test_technologies_take_one_scan_and_one_exchange(spark, make_files, tmp_path):
    stored = str(tmp_path / "files")
    make_files({"composer.json": '{"require": {"slim/slim": "^4.1"}}', "k8s/a.yaml": "kind: x", "x.php": ""}).write.parquet(stored)
    tech = technology.technologies(spark.read.parquet(stored))
    plan = tech._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning(project") == plan.count("Exchange ") == 1
    # The first manifests of all names are decided in walk order, whichever task read them.
    names = {"b/composer.json": '{"require": {"laravel/framework": "^9"}}', "a/z/composer.json": '{"require-dev": {"slim/slim": "~4.1"}}'}
    got = {r.name: (r.version, r.evidence) for r in technology.technologies(make_files(names).repartition(2)).collect()}
    assert got == {"PHP": ("", ["composer.json present"]), "Slim": ("4.1", ["composer.json requires slim/slim 4.1"])}
    assert [r.path for r in technology.first_manifests(make_files(names)).collect()] == ["a/z/composer.json"]
