"""Line operators against plain loops on random text."""

import random

from pyspark.sql import functions as F

from faultlens.functions import text
from faultlens.operators import codelines


def block_states(lines):
    inside, out = False, []
    for line in lines:
        out.append(inside)
        if inside:
            inside = "*/" not in line
        else:
            at = line.rfind("/*")
            inside = at >= 0 and "*/" not in line[at:]
    return out


def is_comment(t):
    return t.startswith(("//", "#", "*", "/*", "<!--"))


def empty_bodies(lines):
    out = []
    for i, line in enumerate(lines):
        at = line.find("{")
        flag = False
        if at >= 0 and line[at + 1 :].strip() == "":
            for later in lines[i + 1 :]:
                t = later.strip()
                if t == "" or is_comment(t):
                    continue
                flag = t == "}"
                break
        out.append(flag)
    return out


def strip_comment(line, ext):
    hashes = ext in (".php", ".py", ".rb")
    quote, i = None, 0
    while i < len(line):
        c = line[i]
        if quote:
            if c == "\\":
                i += 2
                continue
            if c == quote:
                quote = None
        elif c in "'\"`":
            quote = c
        elif c == "/" and line[i + 1 : i + 2] == "/":
            return line[:i].rstrip(" \t")
        elif c == "#" and hashes and not (ext == ".php" and line[i + 1 : i + 2] == "["):
            return line[:i].rstrip(" \t")
        i += 1
    return line


def test_block_comments_and_empty_bodies(spark, make_files):
    rng = random.Random(7)
    pieces = ["/*", "*/", "/*/", "x", " ", "catch (e)", "{", "}", "//", "*", "#", "\x00b", "\x00", "\x01"]
    contents, expected = {}, {}
    for f in range(300):
        lines = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 14))]
        # Keep NULs away from the first 1024 bytes, where they would mean a binary file.
        lines = ["catch " + "y" * 1100] + lines
        contents[f"f{f}.js"] = rng.choice(["\n", "\r\n"]).join(lines)
        expected[f"f{f}.js"] = list(zip(lines, block_states(lines), empty_bodies(lines)))
    rows = codelines.source_lines(make_files(contents)).collect()
    got = {}
    for r in rows:
        ends_in_brace = r.line.find("{") >= 0 and r.line[r.line.find("{") + 1 :].strip() == ""
        got.setdefault(r.path, []).append((r.line_no, r.line, r.in_block, r.empty_body and ends_in_brace))
    for path, want in expected.items():
        have = [x[1:] for x in sorted(got[path])]
        assert have == want, path


def test_trailing_comment(spark):
    rng = random.Random(11)
    pieces = ["'", '"', "`", "\\", "/", "//", "#", "#[", "a", " ", "\t", "http://x"]
    rows = []
    for ext in (".php", ".py", ".rb", ".js", ".java", ".go"):
        for _ in range(700):
            rows.append((ext, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))))
    df = spark.createDataFrame(rows, "ext string, line string")
    done = df.select("ext", "line", text.strip_trailing_comment(F.col("line"), F.col("ext")).alias("code"))
    wrong = [r for r in done.collect() if r.code != strip_comment(r.line, r.ext)]
    assert wrong == []


def test_skipped_files(spark, make_files):
    files = make_files({"a.php": "x", "b.php": "y\x00z", "c.php": "q" * 2000 + "\x00"})
    big = files.withColumn("size", F.when(F.col("path") == "a.php", F.lit(3_000_000)).otherwise(F.col("size")))
    assert [r.path for r in codelines.readable_text(big).collect()] == ["a.php", "c.php"]
    assert [r.path for r in codelines.readable_text(big, 1_000_000).collect()] == ["c.php"]


def test_truncation_counts_bytes(spark):
    row = spark.createDataFrame([("é" * 100, "a" * 161)], "u string, v string").select(
        text.snippet(F.col("u")).alias("u"), text.snippet(F.col("v")).alias("v"), text.trim(F.lit("  x ")).alias("t")
    ).first()
    assert row.u == "é" * 80 + "…"
    assert row.v == "a" * 160 + "…"
    assert row.t == "x"


def test_line_of(spark):
    df = spark.createDataFrame([("a\nb\nc",)], "s string")
    row = df.select(text.line_of(F.col("s"), F.lit("c")).alias("c"), text.line_of(F.col("s"), F.lit("z")).alias("z")).first()
    assert (row.c, row.z) == (3, 1)
