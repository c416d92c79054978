"""Source files to lines, with comment state and catch-block look-ahead.

Both multi-line facts are found by a regular expression over the whole file text
before it is split, so a file never has to be regrouped: no window, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions import paths
from faultlens.functions.text import BLANK_IN_LINE, MASKED_START, MASKED_START_HASH
from faultlens.functions.text import HASH_COMMENT_EXTS

#: Lines beyond this many bytes are reported as long; they are analysed like all others.
LONG_LINE_BYTES = 500
#: A NUL among so many first bytes marks a binary file.
BINARY_PROBE_BYTES = 1024

# Marks put into the text before it is split. NULs of the text itself become _NUL, so that
# a mark can never be taken for text.
_BLOCK, _EMPTY, _NUL = "\x00b", "\x00e", "\x00n"

# A block comment still open at the end of its line, or a further line right after such a
# match (or after another further line). Group 2 takes the line that closes the comment,
# without its line end, which stops the chain. Both branches fail at once on most characters.
_BLOCK_LINES = r"((?:/\*(?!/)(?:[^*\n]|\*(?!/))*+|\G(?<=\n)[^\n]*+)\n)([^\n]*\*/[^\n]*+)?"

# A "{" at the end of a line after which the next line with content, comments skipped, is
# a lone "}".
_B = f"[{BLANK_IN_LINE}]*+"
_EMPTY_BODY = (
    r"(\{" + _B + r")(?=\n(?:" + _B + r"(?:(?://|#|\*|/\*|<!--)[^\n]*+)?\n)*+" + _B + r"\}" + _B + r"(?:\n|\z))"
)


def is_binary(content: Column) -> Column:
    """A NUL within the first 1024 bytes."""
    # As many characters hold at least as many bytes.
    probe = F.substring(content, F.lit(1), F.lit(BINARY_PROBE_BYTES))
    at = F.locate("\x00", probe)
    return (at > 0) & (F.octet_length(F.substring(probe, F.lit(1), at - 1)) < BINARY_PROBE_BYTES)


def readable_text(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Files that are not binary; only those within ``max_bytes``, where a caller sets it."""
    within = files if max_bytes is None else files.where(F.col("size") <= max_bytes)
    return within.where(~is_binary(F.col("content")))


CORE_MARKER = "/core/CodeIgniter.php"


def system_dir(path: Column) -> Column:
    """The innermost directory named ``system`` above a file; empty without one."""
    return F.regexp_extract(path, "(?is)^((?:.*/)?system)/", 1)


def core_dirs(placed: DataFrame) -> DataFrame:
    """``(project, core_dir)``: those directories of ``placed(project, path, core_dir)`` that hold a
    framework core or lie below one that does.

    ``core_dir`` is the innermost directory named ``system`` of a file, which lies in a core exactly
    when that directory is in the result. A null path places a directory without a file.
    """
    path, system = F.col("path"), F.col("core_dir")
    systems = placed.groupBy("project", "core_dir").agg(F.bool_or(path == F.concat(system, F.lit(CORE_MARKER))).alias("_core"))
    cores = systems.where("_core").select("project", F.col("core_dir").alias("_above"))
    # A core needs no other above it, so both sides read one aggregate.
    above = F.when(F.col("_core"), F.array(system)).otherwise(paths.ancestors(system))
    return (
        systems.select("project", "core_dir", F.explode(above).alias("_above"))
        .join(cores, ["project", "_above"], "left_semi")
        .select("project", "core_dir")
        .distinct()
    )


def without_framework_core(files: DataFrame) -> DataFrame:
    """Drop everything below a vendored framework core.

    Tables loaded from trees carry the answer in ``in_core``. Otherwise a file with a
    ``system`` directory above it is looked up by the innermost one; no other file is shuffled.
    """
    if "in_core" in files.columns:
        return files.where(~F.coalesce(F.col("in_core"), F.lit(False)))
    has_system = F.lower(F.concat(F.lit("/"), F.col("path"))).contains("/system/")
    candidates = files.where(has_system).withColumn("core_dir", system_dir(F.col("path")))
    kept = candidates.join(core_dirs(candidates), ["project", "core_dir"], "left_anti")
    return files.where(~has_system).unionByName(kept.select(*files.columns))


def analysed_paths(files: DataFrame) -> DataFrame:
    """Files outside ignored, vendored and framework-core directories."""
    return without_framework_core(files.where(~paths.in_vendored_dir(F.col("path"))))


def unit(files: DataFrame, name: str) -> DataFrame:
    """Restrict a table partitioned by unit to the partitions a group of rules reads."""
    if "unit" not in files.columns:
        return files
    both = ["code_and_config"] if name in ("code", "config") else []
    return files.where(F.col("unit").isin(name, *both))


def code_files(files: DataFrame) -> DataFrame:
    """The files the code rules read, by path alone."""
    path = F.col("path")
    return unit(files, "code").where(
        ~paths.is_manifest(path) & ~paths.is_minified(path) & paths.is_source(path)
    )


def normalised_body(content: Column) -> Column:
    return F.replace(content, F.lit("\r\n"), F.lit("\n"))


def source_lines(files: DataFrame) -> DataFrame:
    """``(project, path, ext, benign_path, line_no, line, in_block, empty_body)`` of readable
    code files.

    ``in_block``: the line lies inside a block comment opened above it.
    ``empty_body``: the block opened by a "{" at the end of this line has no content.
    ``benign_path``: the file is a place where credential-like text is expected.
    """
    texts = readable_text(files).select(
        "project",
        "path",
        paths.extension(F.col("path")).alias("ext"),
        paths.benign_secret_path(F.col("path")).alias("benign_path"),
        F.replace(normalised_body(F.col("content")), F.lit("\x00"), F.lit(_NUL)).alias("body"),
    )
    body, ext = F.col("body"), F.col("ext")
    may_catch = ext.isin(".php", ".js", ".ts", ".java") & body.rlike("(?i)catch")
    # The look-ahead first: it must not see the other marks.
    with_empty = F.when(may_catch, F.regexp_replace(body, _EMPTY_BODY, "$1" + _EMPTY)).otherwise(body)
    marked = F.when(
        body.contains("/*"), F.regexp_replace(with_empty, _BLOCK_LINES, "$1" + _BLOCK + "$2")
    ).otherwise(with_empty)
    kept = ("project", "path", "ext", "benign_path")
    rows = texts.select(*kept, F.posexplode(F.split(marked, "\n", -1)).alias("pos", "raw"))
    raw = F.col("raw")
    plain = F.replace(F.replace(raw, F.lit(_BLOCK), F.lit("")), F.lit(_EMPTY), F.lit(""))
    plain = F.replace(plain, F.lit(_NUL), F.lit("\x00"))
    return rows.select(
        *kept,
        (F.col("pos") + 1).alias("line_no"),
        F.when(raw.contains("\x00"), plain).otherwise(raw).alias("line"),
        raw.startswith(_BLOCK).alias("in_block"),
        raw.endswith(_EMPTY).alias("empty_body"),
    )


def is_code(line: Column, ext: Column, in_block: Column) -> Column:
    """Neither blank nor comment, given the block state."""
    masked = F.when(ext.isin(*HASH_COMMENT_EXTS), line.rlike(MASKED_START_HASH)).otherwise(
        line.rlike(MASKED_START)
    )
    return ~in_block & ~masked
