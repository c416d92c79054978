"""Remediation guidance by CWE, else by category, else a neutral default."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# CWE -> (exploit, complexity, effort, fix example).
BY_CWE = {
    "CWE-798": (
        "Anyone with source/repo access (or via a leak) can use the credential to access the linked service or data.",
        "Low", "~15 min",
        'Before: $apiKey = "sk_live_abc123";\nAfter:  $apiKey = getenv("STRIPE_API_KEY"); // load from env/secret store, rotate the leaked key',
    ),
    "CWE-89": (
        "An attacker submits crafted input (e.g. ' OR '1'='1) to read, modify, or delete database records.",
        "Medium", "~30 min per query",
        'Before: $db->query("SELECT * FROM users WHERE id = " . $id);\nAfter:  $db->query("SELECT * FROM users WHERE id = ?", [$id]); // parameterized',
    ),
    "CWE-79": (
        "An attacker supplies a value containing <script>…</script>; it executes in another user's browser (session theft, defacement).",
        "Low", "~15 min",
        "Before: echo $_GET['name'];\nAfter:  echo htmlspecialchars($_GET['name'], ENT_QUOTES, 'UTF-8');",
    ),
    "CWE-78": (
        "Crafted input is concatenated into a shell command, letting an attacker run arbitrary commands on the server.",
        "Medium", "~30–60 min",
        "Before: exec(\"convert \" . $_GET['f']);\nAfter:  exec('convert ' . escapeshellarg($file)); // validate against an allow-list",
    ),
    "CWE-95": (
        "Attacker-controlled input reaches eval(), executing arbitrary code.",
        "Medium", "~30–60 min",
        "Replace eval() with a safe alternative (JSON.parse, a function/lookup map).",
    ),
    "CWE-22": (
        "Input like ../../etc/passwd lets an attacker read or include files outside the intended directory.",
        "Medium", "~30 min",
        "Before: include $_GET['page'];\nAfter:  $allowed = ['home'=>'home.php']; include $allowed[$_GET['page']] ?? '404.php';",
    ),
    "CWE-918": (
        "An attacker supplies an internal URL (e.g. http://169.254.169.254/) so the server fetches internal resources/metadata.",
        "Medium", "~1 hour",
        "Validate the URL against an allow-list of hosts/schemes before making the request; block private IP ranges.",
    ),
    "CWE-502": (
        "Crafted serialized input triggers object injection, which can escalate to remote code execution.",
        "Medium", "~1 hour",
        "Before: $o = unserialize($_POST['data']);\nAfter:  $o = json_decode($_POST['data'], true); // or unserialize($x, ['allowed_classes' => false])",
    ),
    "CWE-295": (
        "With verification off, a man-in-the-middle can present any certificate and intercept/modify the HTTPS traffic.",
        "Low", "~10 min",
        "Before: curl_setopt($ch, CURLOPT_SSL_VERIFYPEER, false);\nAfter:  curl_setopt($ch, CURLOPT_SSL_VERIFYPEER, true);",
    ),
    "CWE-327": (
        "md5/sha1 hashes are fast and unsalted, so leaked password hashes can be brute-forced quickly.",
        "Medium", "~30 min",
        "Before: $h = md5($password);\nAfter:  $h = password_hash($password, PASSWORD_DEFAULT); // bcrypt/argon2",
    ),
    "CWE-352": (
        "A malicious page makes an authenticated user's browser submit a forged state-changing request (transfer, password/email change) without their intent.",
        "Low", "~20 min",
        "Enable CSRF protection and include the token in every form.\nCodeIgniter: $config['csrf_protection'] = TRUE;\nLaravel:     add the @csrf directive inside each <form>.",
    ),
    "CWE-321": (
        "A missing or hardcoded key lets anyone who knows (or guesses) it forge sessions/tokens or decrypt data.",
        "Low", "~15 min",
        "Load a strong, random key from the environment — never commit it.\nBefore: $config['encryption_key'] = '';\nAfter:  $config['encryption_key'] = getenv('APP_KEY'); // 32+ random bytes",
    ),
    "CWE-209": (
        "Verbose errors leak stack traces, queries, and paths that help an attacker map the system.",
        "Low", "~10 min",
        "Disable display_errors / debug in production; log errors to a file instead.",
    ),
    "CWE-20": (
        "Unvalidated request input flows into queries, file paths, or output, enabling injection attacks.",
        "Low", "~15 min",
        "Validate/sanitize input (filter_input, the framework's validation layer) before use.",
    ),
    "CWE-1104": (
        "Known CVEs in outdated dependencies are publicly documented and trivially exploitable.",
        "Low", "~15–30 min",
        "Upgrade the dependency to a patched version; pin it and commit the lock file.",
    ),
    "CWE-1395": (
        "The dependency has a published advisory; exploit details are often public.",
        "Low", "~15–30 min",
        "Upgrade to the fixed version named in the advisory; re-run the scan to confirm.",
    ),
    "CWE-755": (
        "Not directly exploitable, but swallowed exceptions hide failures and security events from monitoring.",
        "Low", "~10 min",
        "Log the exception (with context) and handle or rethrow it — never discard it silently.",
    ),
    "CWE-476": (
        "Not directly exploitable; causes runtime fatals/crashes when the nullable value is empty.",
        "Low", "~10 min",
        "Check the result for null before dereferencing it.",
    ),
}

# The same by category, for findings whose CWE has no entry.
BY_CATEGORY = {
    "Performance": (
        "Not a security issue; degrades performance and scalability under load.",
        "Low", "~15–30 min",
        "Select only needed columns / add appropriate indexes / avoid leading-wildcard LIKE.",
    ),
    "Error Handling": (
        "Not directly exploitable; hides failures and complicates debugging and monitoring.",
        "Low", "~10–20 min",
        "Handle, log, and surface errors; guard nullable values before use.",
    ),
    "Runtime": (
        "A real production failure that has already occurred for users.",
        "Medium", "varies",
        "Reproduce from the stack trace, fix the root cause, and add a regression test.",
    ),
    "Infrastructure": (
        "A misconfigured container/host/web-server setting widens the attack surface or leaks data/credentials from the deployment.",
        "Low", "~15–30 min",
        "Harden the config: run as a non-root user, pin image versions/digests, keep secrets out of images/.env, disable directory listing & version banners, and require TLS 1.2+.",
    ),
}
DEFAULT = ("", "Medium", "varies", "")
FIELDS = ("exploit", "complexity", "effort", "fix_example")


def _table(spark: SparkSession, rows: dict, key: str, prefix: str) -> DataFrame:
    schema = ", ".join([f"{key} string", *[f"{prefix}_{f} string" for f in FIELDS]])
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], schema)


def with_remediation(df: DataFrame) -> DataFrame:
    """Add exploit, complexity, effort and fix example to rows with ``cwe`` and ``category``.

    Both lookups are fixed tables of a few rows, hence broadcast.
    """
    spark = df.sparkSession
    by_cwe = F.broadcast(_table(spark, BY_CWE, "cwe", "w"))
    by_category = F.broadcast(_table(spark, BY_CATEGORY, "category", "g"))
    joined = df.join(by_cwe, "cwe", "left").join(by_category, "category", "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[
            F.coalesce(f"w_{f}", f"g_{f}", F.lit(default)).alias(f)
            for f, default in zip(FIELDS, DEFAULT)
        ],
    )
