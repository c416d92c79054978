"""The corpora and queries on rows that only larger tables hold."""

import datetime
import math
import os

import pytest

import __spark_entry__ as entry
from faultlens.operators import codelines, diffscope, grouping
from faultlens.operators import findings as fo
from faultlens.plans import corpora, project_scan
from faultlens.sources import history, tree


def test_findings_of_large_order_keys(spark, tmp_path):
    """Numbers of emission pass an int from the 2,147,484th order on."""
    keys = [(3_000_000_000, 1, 1, 1), (3_000_000_001, 5_000_000_000, 2, 2), (3, 1, 1, 1)]
    items = spark.createDataFrame(keys, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    items.write.parquet(str(tmp_path / "lineitem.parquet"))
    found = corpora.findings(spark, str(tmp_path))
    rows = sorted((r.ord, r.phase) for r in found.collect())
    assert rows == [(3_101, 1), (3_000_000_000_101, 1), (3_000_000_001_202, 5_000_000_000)]
    groups = grouping.finding_groups(fo.enrich(found)).collect()
    assert sum(g["count"] for g in groups) == 3


# Queries that need the order numbers of findings, and those of them whose rows come in order.
BY_ORDER_NUMBER = [
    "a_17_group_occurrences", "a_22_notification_row", "f_18_top_findings", "o_10_insight_ranking", "o_11_console_findings",
    "o_1_sorted_findings", "o_6_finding_group_order", "o_7_fix_first", "o_9_report_cap", "s_13_json_export", "s_14_csv_export",
    "s_15_sarif_export", "w_8_finding_order",
]
IN_ORDER = {"o_1_sorted_findings", "s_13_json_export", "s_15_sarif_export", "w_8_finding_order"}


def result_with_keys(spark, base, name, far):
    """Rows of a query on findings of which some differ in the far part or order number alone, as the order sees them."""
    near = [(o, o * 7 % 50, o % 9, n) for o in range(1, 50) for n in (1, 2)]
    items = near + [(o + far, p, s + 21, n) for o, p, s, n in near] + [(o, p + far, s + 42, n) for o, p, s, n in near]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{base}/lineitem.parquet")
    at = datetime.datetime(2024, 1, 1)
    happened = [(e, at + datetime.timedelta(minutes=e), e % 20, "error", '{"k": %d}' % (e % 9)) for e in range(40)]
    spark.createDataFrame(happened, "event_id long, ts timestamp, user_id long, event_type string, props string").write.parquet(f"{base}/events.parquet")
    rows = [tuple(r) for r in entry.queries()[name](spark, str(base)).collect()]
    return rows if name in IN_ORDER else sorted(rows, key=repr)


@pytest.mark.parametrize("name", BY_ORDER_NUMBER)
def test_queries_do_not_depend_on_the_size_of_keys(spark, tmp_path, name):
    """Keys beyond an int give the rows of small keys, as what the corpus derives from keys repeats with this step."""
    step = math.lcm(3, 5, 23, 60, *map(len, (corpora.FINDING_RULES, corpora.FINDING_SEVERITIES, corpora.FINDING_CATEGORIES)))
    small, large = (result_with_keys(spark, tmp_path / str(far), name, far) for far in (step, 20_000 * step))
    assert step * 1000 < 2**31 < 20_000 * step
    assert small and large == small


def scans_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation ")


def test_files_below_cores(spark, make_files, tmp_path):
    """Cores in cores, system directories below a core, files and directories of that name."""
    paths = [
        "x/system/core/CodeIgniter.php", "x/system/a/system/b/System/f.php", "x/system/system", "y/system/f.php", "z/SYSTEM/core/CodeIgniter.php",
        "z/SYSTEM/q.php", "z/systems/q.php", "system/core/codeigniter.php", "system/f.php", "w/system/core/CodeIgniter.php/f.php",
        "x/system/n/system/node_modules/f.php", "f.php",
    ]
    files = make_files(dict.fromkeys(paths, "a"))
    kept = {r.path for r in codelines.without_framework_core(files).collect()}
    in_core = {"x/system/core/CodeIgniter.php", "x/system/a/system/b/System/f.php", "x/system/system", "z/SYSTEM/core/CodeIgniter.php",
               "z/SYSTEM/q.php", "x/system/n/system/node_modules/f.php"}
    assert kept == set(paths) - in_core
    flagged = {r.path for r in tree.tree_rows(files).where("in_core").collect()}
    assert flagged == (in_core - {"x/system/n/system/node_modules/f.php"}) | {
        "x/system", "x/system/core", "x/system/a", "x/system/a/system", "x/system/a/system/b", "x/system/a/system/b/System",
        "x/system/n", "x/system/n/system", "z/SYSTEM", "z/SYSTEM/core",
    }


def test_corpus_contents_are_built_above_path_filters(spark, tmp_path):
    """Contents are built for files that pass the path filters: these lie below, not above."""
    spark.range(1, 300).withColumnRenamed("id", "o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    plan = codelines.code_files(corpora.source_files(spark, str(tmp_path)))._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    content = next(i for i, line in enumerate(lines) if "Generate explode(array(CASE" in line)
    assert any("Filter" in line for line in lines[content:]) and not any("Filter" in line for line in lines[:content])


def test_core_lookup_reads_files_four_times(spark, make_files, tmp_path):
    make_files({"system/core/CodeIgniter.php": "", "a.php": ""}).write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    assert scans_of(codelines.without_framework_core(files)) <= 4
    assert project_scan.files_scanned(files).first().files_scanned == 1


def test_trees_are_walked_in_batches(spark, make_files, tmp_path):
    """The entries are those of one walk, however few files a batch has, and no tree is left."""
    paths = ["system/core/CodeIgniter.php", "system/a/f.php", "b/system/core/CodeIgniter.php", "b/c/f.php", "build/x", "f.php", "vendor/y/z", "d/e/f/g"]
    files = make_files(dict.fromkeys(paths, "text")).unionByName(make_files({"core/CodeIgniter.php": "", "a/b.php": "x"}, "system"))
    one = str(tmp_path / "one")
    tree.write_trees(files, one)
    columns = ["path", "is_dir", "size", "in_core"]
    want = sorted(tuple(r) for r in tree.walk(spark, [("all", one)]).where("path like '%/%'").select(*columns).collect())
    for most in (1, 3, 1000):
        base = str(tmp_path / f"most{most}")
        got = tree.written_and_walked(files, base, most).where("path like '%/%'").select(*columns)
        assert sorted(tuple(r) for r in got.collect()) == want
        left = [f for _, _, names in os.walk(f"{base}/trees") for f in names]
        assert left == []


def test_trees_use_up_those_before(spark, make_files, tmp_path):
    """Files and directories are taken over by the trees that follow, one with others of its own, and no row has two."""
    spare, first = str(tmp_path / "spare"), {f"a{i % 7}/b{i}/f{i}": "long text" * (i % 5) for i in range(60)}
    os.makedirs(spare)
    last = {f"c{i % 5}/f{i}": "é" * (i % 4) for i in range(50)} | {f"d{i}/e/f": "" for i in range(9)}
    inodes = []
    for n, texts in enumerate((first, first, last, first)):
        root = str(tmp_path / "trees" / str(n))
        files = make_files(texts, f"p{n}").unionByName(make_files(texts, "q")).repartition(4)
        assert tree.write_trees(files, root, spare) == 2 * len(texts)
        got = {r.path: r.size for r in tree.walk(spark, [("all", root)]).where("not is_dir").collect()}
        assert got == {f"{p}/{path}": len(text.encode()) for p in (f"p{n}", "q") for path, text in texts.items()}
        below = {os.path.relpath(here, root): names for here, _, names in os.walk(root) if here != root}
        assert set(below) == {p + "/" * bool(d) + d for p in (f"p{n}", "q") for path in texts for d in ("", path.split("/")[0], os.path.dirname(path))}
        for p in (f"p{n}", "q"):
            assert all(open(f"{root}/{p}/{path}").read() == text for path, text in texts.items())
        inodes.append([{os.stat(f"{root}/{d}/{name}").st_ino for d, names in below.items() for name in names}, {os.stat(f"{root}/{d}").st_ino for d in below}])
        assert len(inodes[-1][0]) == 2 * len(texts) and len(inodes[-1][1]) == len(below)
        tree.hand_on_trees(spark, root, spare)
    assert inodes[1][0] & inodes[0][0] and inodes[2][0] & inodes[1][0] and inodes[2][1] & inodes[0][1]
    tree.remove_spares(spark, str(tmp_path / "trees"), spare)
    assert os.listdir(tmp_path) == []


def test_trees_are_removed_where_nothing_can_be_taken_over(spark, make_files, tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "_can_spare", lambda folder: False)
    files = make_files({"a/f": "x", "b/c/g": "", "h": "y"})
    got = tree.written_and_walked(files, str(tmp_path), 1).where("not is_dir")
    assert sorted((r.path, r.size) for r in got.collect()) == [("p/a/f", 1), ("p/b/c/g", 0), ("p/h", 1)]
    assert [f for _, _, names in os.walk(tmp_path / "trees") for f in names] == []


def test_long_files_reach_python_in_small_batches(spark, tmp_path, monkeypatch):
    """Batches are bounded by bytes, not by rows alone."""
    seen = str(tmp_path / "seen")
    os.makedirs(seen)

    def noted(base):
        def run(batches):
            for i, batch in enumerate(batches):
                with open(f"{seen}/{i}", "w") as f:
                    f.write(str(int(batch["content"].str.len().sum())))
                yield batch[["n"]] if "n" in batch else batch.assign(n=1)[["n"]]

        return run

    monkeypatch.setattr(tree, "_write", noted)
    files = spark.range(0, 60, 1, 1).selectExpr("'p' AS project", "concat('f', id) AS path", "repeat('x', 1000000) AS content")
    assert tree.write_trees(files, str(tmp_path / "out")) == 60
    sizes = [int(open(f"{seen}/{name}").read()) for name in os.listdir(seen)]
    assert sum(sizes) == 60_000_000 and max(sizes) <= 2 * tree.BATCH_BYTES


def test_hunks_travel_parsed(spark, tmp_path):
    """Ranges of headers buckets before their hunks; hunks that add nothing or cannot be read leave before the shuffle."""
    texts = {
        5: "+++ b/a.php", 6: "@@ -1 +3 @@", 7: "@@ broken", 8: "@@ -1,2 +9,0 @@", 9: "@@ -1,2 +99999999999,2 @@", 10: "@@ -1 +5,99999999999 @@",
        25_000: "@@ -1,7 +11,2 @@ f()", 25_001: "+++ /dev/null", 45_000: "@@ -1 +50,2 @@", 45_001: "+++ b/./b.php", 45_002: "x@@ -1 +7 @@", 45_003: "@@ -1 +4097 @@",
    }
    lines = spark.createDataFrame([(p, n, t) for p in ("p", "q") for n, t in texts.items()], "project string, line_no long, text string")
    lines = lines.unionByName(spark.createDataFrame([("r", 1, "@@ -1 +3 @@"), (None, 1, "+++ b/n.php")], lines.schema))
    lines.write.parquet(str(tmp_path / "diff"))
    stored = spark.read.parquet(str(tmp_path / "diff"))
    spans = diffscope.changed_spans(stored)
    got = {(r.project, r.file, r.bucket): [tuple(s) for s in r.spans] for r in spans.collect()}
    one = {("a.php", -1): [], ("a.php", 0): [(3, 3), (11, 12)], ("b.php", -1): [], ("b.php", 1): [(4097, 4097)]}
    assert got == {(p, *k): v for p in ("p", "q") for k, v in one.items()} | {(None, "n.php", -1): []}
    plan = spans._jdf.queryExecution().optimizedPlan().toString()
    # The outer exchange deals the pieces, the inner one the parsed lines; what is carried is aggregated before it is dealt.
    _, pieces, _ = plan.split("RepartitionByExpression")
    assert "text#" not in pieces
    files, _ = diffscope.changed_lines(stored)
    assert {(r.project, r.file) for r in files.collect()} == {("p", "a.php"), ("p", "b.php"), ("q", "a.php"), ("q", "b.php"), (None, "n.php")}
    assert "Window" not in files._jdf.queryExecution().optimizedPlan().toString()


def test_gate_and_counts_share_one_reading(spark, tmp_path):
    """The gate sums what counts by severity hold; both read the findings by one exchange."""
    rows = [("p", "High"), ("p", "High"), ("p", "Low"), ("q", "odd"), ("r", "Critical"), (None, "High")]
    spark.createDataFrame(rows, "project string, severity string").write.parquet(str(tmp_path / "found"))
    found = spark.read.parquet(str(tmp_path / "found"))
    projects = spark.createDataFrame([("p",), ("q",), ("r",), ("s",)], "project string")
    gate = fo.gate(found, projects, "high")
    assert {(r.project, r.fail_count, r.passed) for r in gate.collect()} == {("p", 2, False), ("q", 0, True), ("r", 1, False), ("s", 0, True)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = fo.by_severity(found).join(gate, "project")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("FileScan parquet") == 1 and "ReusedExchange" in plan


def test_corpus_lines_are_compiled(spark, tmp_path):
    """Texts of the corpora are spelled out, not built by functions over arrays; a null key has none."""
    keys = spark.createDataFrame([(0,), (5,), (8,), (None,)], "o_orderkey long")
    keys.write.parquet(str(tmp_path / "orders.parquet"))
    keys.toDF("p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    for files, counts in ((corpora.source_files, [6, 11, 14, None]), (corpora.config_files, [5, 10, 5, None])):
        df = files(spark, str(tmp_path))
        assert "lambdafunction" not in df._jdf.queryExecution().optimizedPlan().toString()
        got = sorted((r.content.count("\n") + 1 for r in df.collect() if r.content is not None))
        assert got == sorted(n for n in counts if n) and df.where("content IS NULL").count() == 1


def test_replay_sorts_a_history_once(spark, tmp_path, monkeypatch):
    """Totals before come from one sort by path, or, of paths with many scans, month by month; no records are joined to them."""
    rows = [
        ("1", "/a", "2024-01-01", 5), ("2", "/a", "2024-01-02", None), ("3", "/a", "2024-01-03", 9), ("4", "/a", "2024-04-01", 4), ("5", "/a", "2024-04-02", 14),
        ("6", "/b", "2024-02-01", 3), ("7", "/a", None, 2), ("8", None, "2024-01-01", 1), ("9", "/b", "2024-03-01", 8), ("0", "/c", "", 8), ("a", "/c", "2024-03-01", None),
        ("b", "/c", "2024-04-01", 7), ("c", "/c", "2024-04-01", 8),
    ]
    spark.createDataFrame(rows, "id string, path string, created_at string, total long").write.parquet(str(tmp_path / "scans"))
    scans = spark.read.parquet(str(tmp_path / "scans"))
    want = {
        "1": (2, 3), "2": (5, 0), "3": (2, 7), "4": (9, 0), "5": (4, 10), "6": (None, 0), "9": (3, 5), "0": (None, 0), "a": (8, 0),
        "b": (None, 0), "c": (7, 1),
    }
    for many in (0, 2, 100):
        monkeypatch.setattr(history, "MANY_SCANS", many)
        got = {r.id: (r.previous_total, r.new_since) for r in history.replay_new_since(scans).collect()}
        assert got == want
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = history.replay_new_since(scans)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert "SortMergeJoin" not in plan
