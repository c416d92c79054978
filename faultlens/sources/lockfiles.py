"""Pinned dependencies from lock files and requirement lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions import paths, text

_COMPOSER_LOCK = (
    "packages ARRAY<STRUCT<name STRING, version STRING>>, "
    "`packages-dev` ARRAY<STRUCT<name STRING, version STRING>>"
)
_NPM_LOCK = (
    "packages MAP<STRING, STRUCT<version STRING>>, dependencies MAP<STRING, STRUCT<version STRING>>"
)
_PIN = r"^([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*==\s*([^\s;#,]+)"
_GO_REQUIRE = r"^(?:require\s+)?([a-zA-Z0-9.-]+\.[a-zA-Z]+(?:/\S+)*)\s+(v[0-9][^\s]*)"

_PAIRS = "array<struct<name:string,version:string>>"


def _composer(content: Column) -> Column:
    doc = F.from_json(content, _COMPOSER_LOCK)
    none = F.array().cast(_PAIRS)
    return F.concat(F.coalesce(doc["packages"], none), F.coalesce(doc["packages-dev"], none))


def _npm(content: Column) -> Column:
    """Version 2/3 locks list install paths, version 1 locks list names."""
    doc = F.from_json(content, _NPM_LOCK)
    new = F.transform(
        F.filter(F.map_entries(doc["packages"]), lambda e: e["key"] != ""),
        lambda e: F.struct(
            F.regexp_replace(e["key"], "^.*node_modules/", "").alias("name"),
            e["value"]["version"].alias("version"),
        ),
    )
    old = F.transform(
        F.map_entries(doc["dependencies"]),
        lambda e: F.struct(e["key"].alias("name"), e["value"]["version"].alias("version")),
    )
    return F.coalesce(new, old, F.array().cast(_PAIRS))


def _by_line(content: Column, pattern: str) -> Column:
    lines = F.transform(F.split(content, "\n", -1), lambda ln: text.trim(ln))
    return F.transform(
        F.filter(lines, lambda ln: ln.rlike(pattern)),
        lambda ln: F.struct(
            F.regexp_extract(ln, pattern, 1).alias("name"), F.regexp_extract(ln, pattern, 2).alias("version")
        ),
    )


def dependencies(files: DataFrame) -> DataFrame:
    """``(project, source, ecosystem, name, version)`` of every pinned dependency.

    ``composer.lock`` and ``==`` pins of ``requirements.txt`` follow the known behaviour;
    ``package-lock.json`` and ``go.mod`` are read by rules of our own.
    """
    name, content = paths.basename(F.col("path")), F.col("content")
    ecosystem = (
        F.when(name == "composer.lock", "Packagist")
        .when(name == "requirements.txt", "PyPI")
        .when(name == "package-lock.json", "npm")
        .when(name == "go.mod", "Go")
    )
    pairs = (
        F.when(name == "composer.lock", _composer(content))
        .when(name == "requirements.txt", _by_line(content, _PIN))
        .when(name == "package-lock.json", _npm(content))
        .when(name == "go.mod", _by_line(content, _GO_REQUIRE))
    )
    named = files.where(
        name.isin("composer.lock", "requirements.txt", "package-lock.json", "go.mod")
        & ~paths.in_ignored_dir(F.col("path"))
    )
    return (
        named.select("project", F.col("path").alias("source"), ecosystem.alias("ecosystem"), F.inline(pairs))
        .where((F.col("name") != "") & (F.col("version") != ""))
    )
