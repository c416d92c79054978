"""Predicates and labels on project-relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultlens.functions.severity import lookup
from faultlens.functions.text import contains_any, ends_with_any, starts_with_any

# Directory names that are never walked, and those skipped by analysis.
IGNORED_DIRS = (
    ".git", "node_modules", "vendor", "dist", "build", ".idea", ".vscode",
    "__pycache__", ".venv", "venv", "target", "bin", "obj",
)
VENDORED_DIRS = ("assets", "bower_components", "vendors", "third_party", "third-party")

# Extensions that the code rules read.
SOURCE_EXTS = (".php", ".js", ".ts", ".jsx", ".tsx", ".py", ".java", ".rb", ".go")
DEPENDENCY_MANIFESTS = ("composer.json", "package.json")

# Manifest names and their labels, backend manifests, extension languages.
MARKERS = {
    "composer.json": "PHP (Composer)",
    "package.json": "Node.js (npm)",
    "requirements.txt": "Python (pip)",
    "pyproject.toml": "Python (PEP 518)",
    "pom.xml": "Java (Maven)",
    "build.gradle": "Java (Gradle)",
    "go.mod": "Go (modules)",
    "Gemfile": "Ruby (Bundler)",
    "Dockerfile": "Docker",
    "docker-compose.yml": "Docker Compose",
}
BACKEND_LANGUAGE = {
    "composer.json": "PHP",
    "requirements.txt": "Python",
    "pyproject.toml": "Python",
    "pom.xml": "Java",
    "build.gradle": "Java",
    "go.mod": "Go",
    "Gemfile": "Ruby",
}
EXT_LANGUAGE = {
    ".php": "PHP",
    ".js": "JavaScript",
    ".ts": "TypeScript",
    ".jsx": "JavaScript",
    ".tsx": "TypeScript",
    ".py": "Python",
    ".java": "Java",
    ".go": "Go",
    ".rb": "Ruby",
    ".cs": "C#",
}


def parts(path: Column) -> Column:
    return F.split(path, "/", -1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ancestors(path: Column) -> Column:
    """Every directory above a file, outermost first; empty for a top-level file."""
    p = parts(path)
    depth = F.size(p) - 1
    return F.when(
        depth > 0,
        F.transform(F.sequence(F.lit(1), depth), lambda n: F.array_join(F.slice(p, 1, n), "/")),
    ).otherwise(F.array().cast("array<string>"))


def directories(path: Column) -> Column:
    """Names of the directories above a file."""
    p = parts(path)
    return F.slice(p, 1, F.size(p) - 1)


def in_ignored_dir(path: Column) -> Column:
    return F.arrays_overlap(directories(path), F.array(*[F.lit(d) for d in IGNORED_DIRS]))


def in_vendored_dir(path: Column) -> Column:
    lowered = F.transform(directories(path), F.lower)
    return in_ignored_dir(path) | F.arrays_overlap(
        lowered, F.array(*[F.lit(d) for d in VENDORED_DIRS])
    )


def extension(path: Column) -> Column:
    """Lower-cased text from the last dot of the name, dot included; empty without a dot."""
    name = basename(path)
    return F.when(
        name.contains("."), F.lower(F.concat(F.lit("."), F.substring_index(name, ".", -1)))
    ).otherwise(F.lit(""))


def is_minified(path: Column) -> Column:
    return ends_with_any(F.lower(basename(path)), (".min.js", ".bundle.js", "-min.js"))


def is_source(path: Column) -> Column:
    return extension(path).isin(*SOURCE_EXTS)


def is_manifest(path: Column) -> Column:
    return basename(path).isin(*DEPENDENCY_MANIFESTS)


def role(path: Column) -> Column:
    """Architectural role: name words first, then directory conventions; null if none.

    Works on the relative path with a leading slash, so the place where a project
    happens to be checked out does not matter.
    """
    low = F.concat(F.lit("/"), F.lower(path))
    base = basename(low)
    return (
        F.when(base.contains("test"), "Tests")
        .when(base.contains("controller"), "Controllers")
        .when(base.contains("service"), "Services")
        .when(base.contains("model"), "Models")
        .when(base.contains("migration"), "Migrations")
        .when(contains_any(low, ("/tests/", "/test/")), "Tests")
        .when(contains_any(low, ("/controllers/", "/controller/")), "Controllers")
        .when(contains_any(low, ("/services/", "/service/")), "Services")
        .when(contains_any(low, ("/models/", "/model/")), "Models")
        .when(
            contains_any(low, ("/views/", "/view/")) | ends_with_any(base, (".blade.php", ".twig")),
            "Views",
        )
        .when(low.contains("migration"), "Migrations")
        .when(
            low.contains("/config/") | (base == "config.php") | base.endswith(".env"), "Config"
        )
    )


def benign_secret_path(path: Column) -> Column:
    """Places where credential-like literals are expected: language tables, tests,
    seeders, example files and UI templates."""
    p = F.lower(F.translate(path, "\\", "/"))
    return (
        starts_with_any(p, ("lang/", "tests/", "test/"))
        | contains_any(
            p,
            (
                "/lang/", "/translations/", "/locale/", "/locales/", "/tests/", "/test/",
                "/seeders/", "/seeds/", "/factories/", ".example.",
            ),
        )
        | ends_with_any(
            p,
            (
                "_test.go", ".test.js", ".test.ts", ".spec.js", ".spec.ts", ".example", ".dist",
                ".sample", ".blade.php", ".twig", ".vue", ".html", ".htm",
            ),
        )
    )


def normalise(path: Column) -> Column:
    """Forward slashes and no leading ``./``."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")


def relative_to(path: Column, root: Column) -> Column:
    """Path below ``root`` when it lies inside it, otherwise the path itself."""
    clean = F.translate(path, "\\", "/")
    base = F.regexp_replace(F.translate(root, "\\", "/"), "/+$", "")
    inside = (base != "") & F.startswith(clean, F.concat(base, F.lit("/")))
    return F.when(inside, F.substring(clean, F.length(base) + 2, F.length(clean))).otherwise(
        F.regexp_replace(clean, r"^\./", "")
    )


def marker_label(name: Column) -> Column:
    return lookup(name, MARKERS, None)


def backend_language(name: Column) -> Column:
    return lookup(name, BACKEND_LANGUAGE, None)


def language(ext: Column) -> Column:
    return lookup(ext, EXT_LANGUAGE, None)


def config_kind(path: Column, content: Column) -> Column:
    """Which family of configuration rules reads a file; null if none does."""
    base = F.lower(basename(path))
    yaml = ends_with_any(base, (".yml", ".yaml"))
    return (
        F.when(
            (base == "dockerfile") | base.startswith("dockerfile.") | base.endswith(".dockerfile"),
            "dockerfile",
        )
        .when(
            base.isin("compose.yml", "compose.yaml") | (base.startswith("docker-compose") & yaml),
            "compose",
        )
        .when(
            base.startswith(".env"),
            F.when(~contains_any(base, ("example", "sample", "dist", "template")), "env"),
        )
        .when(base.isin("nginx.conf", ".htaccess", "httpd.conf", "apache2.conf"), "webserver")
        .when(yaml & content.contains("apiVersion:") & content.contains("kind:"), "k8s")
    )


def may_be_config(path: Column) -> Column:
    """A family of configuration rules may read the file, whatever it holds."""
    # Stand-in content that lets every YAML file pass.
    return config_kind(path, F.lit("apiVersion: kind:")).isNotNull()


def cwe_link(cwe: Column) -> Column:
    number = F.regexp_extract(cwe, r"(?s)^CWE-(.+)$", 1)
    return F.when(
        number != "",
        F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), number, F.lit(".html")),
    ).otherwise(F.lit(""))


def owasp_link(owasp: Column) -> Column:
    code = F.translate(F.substring_index(owasp, " ", 1), ":", "_")
    title = F.translate(F.regexp_extract(owasp, r"(?s)^[^ ]* (.*)$", 1), " ", "_")
    return (
        F.when(owasp == "", F.lit(""))
        .when(~owasp.contains(" "), F.lit("https://owasp.org/Top10/"))
        .otherwise(F.concat(F.lit("https://owasp.org/Top10/"), code, F.lit("-"), title, F.lit("/")))
    )


def editor_link(root: Column, file: Column, line: Column) -> Column:
    """Deep link that opens the file at its line in an editor; empty without a file."""
    clean_root = F.regexp_replace(root, "/+$", "")
    full = F.when(file.startswith("/"), file).otherwise(F.concat(clean_root, F.lit("/"), file))
    link = F.concat(F.lit("vscode://file/"), F.replace(full, F.lit(" "), F.lit("%20")))
    at_line = F.when(line > 0, F.concat(F.lit(":"), line.cast("string"))).otherwise(F.lit(""))
    return F.when(file == "", F.lit("")).otherwise(F.concat(link, at_line))
