"""Risk signals of changes: patterns over added and removed lines, combined to vectors and one score.

A signal is a row of a table: the patterns whose hits count, on which side of the diff, with the weight of one hit. All
patterns of a signal are one alternation, so a line is read once for each signal, whole batches at a time; hits are counted for
each commit in one aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from codequarry.tables import spread

# For each signal its vector, its weight, what one hit adds, the sides on which lines count, and the patterns,
# read without regard to case.
SIGNALS: dict[str, tuple[str, float, float, str, tuple[str, ...]]] = {
    "new_external_http_call": ("security", 1.5, 0.4, "added", (r"requests\.(get|post|put|patch|delete|head|request)\s*\(", r"httpx\.(get|post|put|patch|delete|AsyncClient|Client)\s*\(", r"urllib\.request\.(urlopen|urlretrieve)", r"urllib2?\.(urlopen|Request)", r"\bfetch\s*\(", r"axios\.(get|post|put|patch|delete)\s*\(", r"curl_exec\s*\(", r"http\.(get|post|request)\s*\(", r"RestTemplate\b|WebClient\b|HttpClient\b")),
    "crypto_function_changed": ("security", 2.0, 0.35, "both", (r"\b(encrypt|decrypt|cipher|AES|RSA|DES|hmac|sha\d|md5|bcrypt|scrypt|argon2)\b", r"\b(sign|verify|hash|digest)\s*\(", r"crypto\.(create|generate|random)", r"Cipher|MessageDigest|KeyGenerator|SecretKey", r"hashlib\.(md5|sha|pbkdf2|blake)", r"jwt\.(encode|decode|sign|verify)", r"SSL\.|TLS\.|ssl\.")),
    "auth_method_changed": ("security", 1.5, 0.4, "both", (r"\b(authenticate|authorize|login|logout|is_authenticated|has_permission|requires_auth|login_required|permission_required|check_permission|verify_token|validate_token|decode_token)\b", r"@(login_required|permission_required|requires_auth|authenticated|PreAuthorize|Secured|RolesAllowed)", r"\b(BasicAuth|BearerToken|OAuth|SAML|LDAP|SSO)\b")),
    "secret_access_added": ("security", 1.5, 0.5, "added", (r"os\.(environ|getenv)\s*[\[\(]['\"].*?(secret|password|key|token|credential|api_key)", r"getenv\s*\(['\"].*?(SECRET|PASSWORD|KEY|TOKEN|API_KEY)", r"process\.env\.[A-Z_]*(SECRET|PASSWORD|KEY|TOKEN|API)", r"\bSecretManager|ParameterStore|KeyVault|SecretsManager\b", r"\.env\b.*?(secret|password|key|token)", r"config\[.*(secret|password|api_key|token)")),
    "timeout_param_changed": ("availability", 1.5, 0.4, "both", (r"\btimeout\s*=", r"\bconnect_timeout\b|\bread_timeout\b|\bwrite_timeout\b", r"setTimeout\s*\(|setInterval\s*\(", r"\.timeout\s*\(\d", r"@Timeout\b|ReadTimeout|ConnectTimeout|SocketTimeout")),
    "retry_pattern_changed": ("availability", 1.5, 0.45, "both", (r"@retry|@Retry|\.retry\(|max_retries\s*=|retry_on\b", r"\bcircuit.?breaker\b|CircuitBreaker\b|@CircuitBreaker", r"\bfallback\s*=|\bfallbackMethod\b|\.fallback\s*\(", r"\bbackoff\b|exponential_backoff|BackoffPolicy", r"Resilience4j|Hystrix|Polly\b")),
    "exception_handling_changed": ("availability", 1.0, 0.2, "both", (r"^\s*(try\s*:|catch\s*\(|except\s|finally\s*:)", r"\bthrows\s+\w+|\braise\s+\w+", r"@ExceptionHandler\b|@ControllerAdvice\b")),
    "async_model_changed": ("availability", 1.0, 0.3, "both", (r"\basync\s+def\b|\basync\s+function\b", r"\bawait\s+\w|\bawait\s+\(", r"asyncio\.(create_task|gather|run|sleep|wait)", r"Promise\.(all|race|allSettled|resolve|reject)", r"CompletableFuture\b|@Async\b|ExecutorService\b", r"threading\.Thread\b|multiprocessing\.(Process|Pool)")),
    "loop_pattern_changed": ("performance", 1.0, 0.2, "added", (r"^\s+(for\s+\w+\s+in\b|for\s*\(|while\s*\(|forEach\s*\(|\.map\s*\(|\.filter\s*\()", r"\.stream\(\).*\.(map|filter|reduce|collect)\(")),
    "parallelism_changed": ("performance", 1.5, 0.35, "both", (r"asyncio\.(gather|create_task|wait|run_in_executor)", r"ThreadPoolExecutor|ProcessPoolExecutor|concurrent\.futures", r"multiprocessing\.(Pool|Process|Queue)", r"Promise\.all\b|Promise\.allSettled\b", r"parallelStream\(\)|ForkJoinPool\b|@Parallel\b", r"ray\.remote|\.delay\(\)|celery\b")),
    "caching_changed": ("performance", 1.5, 0.4, "both", (r"@(lru_cache|cache|cached_property|Cacheable|CacheEvict|CachePut)\b", r"\b(lru_cache|functools\.cache|cachetools)\b", r"redis\.(get|set|setex|hget|hset)\s*\(", r"memcache|Memcached\b", r"\.cache\s*=|Cache\(\)|CacheManager\b")),
    "db_query_changed": ("performance", 1.0, 0.2, "added", (r"\.(query|execute|fetchall|fetchone|fetch|scalar)\s*\(", r"SELECT\s+.+\s+FROM\b", r"\.(filter|all|get|annotate|aggregate)\s*\(", r"session\.(query|add|delete|commit|flush)", r"@Query\b|JpaRepository\b|EntityManager\b", r"db\.(find|findOne|aggregate|insertOne|updateOne)")),
    "heavy_lib_imported": ("performance", 1.0, 0.4, "added", (r"^\s*(import|from)\s+(numpy|pandas|torch|tensorflow|scipy|dask|ray)\b",)),
    "metric_trace_changed": ("observability", 1.5, 0.35, "both", (r"\b(metrics|statsd|prometheus|datadog|newrelic)\.(inc|gauge|histogram|counter|timing)", r"(tracer|span)\.(start|finish|log|set_tag|add_event)", r"opentelemetry\.|@Timed\b|@Counted\b|MeterRegistry\b", r"Sentry\.(capture|add_breadcrumb)|bugsnag\.")),
    "silent_exception_added": ("observability", 2.0, 0.5, "added", (r"^\s+except\s*:\s*$", r"^\s+except\s+Exception\s*:\s*$", r"^\s+except\s*.*pass\s*$", r"catch\s*\(\s*\w+\s+\w+\s*\)\s*\{\s*\}", r"\.catch\s*\(\s*\(\s*\)\s*=>\s*\{\s*\}")),
    "env_var_changed": ("operations", 1.0, 0.3, "both", (r"^[A-Z_]{3,}\s*=", r"os\.(environ\[|getenv\s*\()['\"]([A-Z_]{3,})", r"process\.env\.([A-Z_]{3,})", r"ENV\s+[A-Z_]{3,}=")),
}
# The same for file names of the diff's headers, for lines once a manifest is touched, and for counts of the graph.
FILE_SIGNALS = {
    "infra_file_changed": ("operations", 1.5, 0.4, r"Dockerfile|docker-compose|\.github/workflows|Makefile|\.gitlab-ci|Jenkinsfile|buildspec|cloudbuild"),
    "new_migration": ("operations", 1.5, 0.6, r"migrations?/.*\.(py|sql)$|alembic/versions/|\d{4}_\d{2}_\d{2}_.*\.sql$|V\d+__.*\.sql$|changelog.*\.xml$"),
}
_DEPENDENCY = r"^[a-zA-Z][\w\-\.]+[>=<!~^]|\"[a-zA-Z][\w\-\.]+\"\s*:\s*\"|<dependency>|<groupId>|^\s+[a-zA-Z][\w\-\.]+\s*=\s*\""
MANIFEST_SIGNALS = {
    "new_package_added": ("dependencies", 2.0, 0.4, "added", _DEPENDENCY + r"|^\s+(gem|pod)\s+['\"]"),
    "package_removed": ("dependencies", 1.5, 0.35, "removed", _DEPENDENCY),
    "heavy_package_added": ("dependencies", 1.0, 0.5, "added", r"\b(torch|tensorflow|scipy|numpy|pandas|dask|ray)\b"),
}
GRAPH_SIGNALS = {"endpoint_exposed": ("security", 1.0), "high_fan_in": ("availability", 1.5), "high_transitive_blast": ("performance", 1.0), "policy_violation": ("operations", 1.5)}
LOG_SIGNAL = ("observability", 2.0, 0.3, r"\b(log|logger|logging)\.(debug|info|warning|error|critical|warn|exception)\s*\(")
LIBRARY_SIGNAL = ("security", 1.0, 0.25)
MANIFESTS = r"requirements\.txt|requirements-|pyproject\.toml|setup\.py|Pipfile|package\.json|package-lock\.json|yarn\.lock|pom\.xml|build\.gradle|Cargo\.toml|Cargo\.lock|go\.mod|go\.sum|Gemfile|composer\.json"
STDLIB = ("os", "sys", "re", "io", "abc", "ast", "copy", "math", "json", "csv", "time", "uuid", "enum", "typing", "pathlib", "logging", "datetime", "hashlib", "itertools", "functools", "collections", "contextlib", "threading", "subprocess", "traceback", "unittest", "dataclasses")
VECTOR_WEIGHTS = {"security": 2.0, "availability": 2.0, "performance": 1.0, "observability": 1.0, "operations": 1.5, "dependencies": 1.0}
FAN_IN_FROM, BLAST_FROM = 5, 10


def pattern(signal: str) -> str:
    """One pattern for all of a signal's."""
    return "(?i)" + "|".join(f"({p})" for p in SIGNALS[signal][4])


def sides(line: Column) -> tuple[Column, Column, Column]:
    """(is added, is removed, text after the sign) of a diff's line; file headers are neither."""
    added = line.startswith("+") & ~line.startswith("+++")
    removed = line.startswith("-") & ~line.startswith("---")
    return added, removed, F.substr(line, F.lit(2))


def _searched() -> list[tuple[str, str, str]]:
    """(signal, side, pattern) of all that is searched in lines; a signal's place is its bit."""
    own = [(s, side, pattern(s)) for s, (_, _, _, side, _) in SIGNALS.items()]
    own += [(s, side, f"(?i){p}") for s, (_, _, _, side, p) in MANIFEST_SIGNALS.items()]
    own += [("_added_logs", "added", f"(?i){LOG_SIGNAL[3]}"), ("_removed_logs", "removed", f"(?i){LOG_SIGNAL[3]}"), ("_required", "added", r"^ *[a-zA-Z][\w\-]+[>=<!~]")]
    return own + [(s, "file", f"(?i){p}") for s, (_, _, _, p) in FILE_SIGNALS.items()] + [("_manifests", "file", f"(?i){MANIFESTS}")]


def _marks(batches):
    """(commit_sha, marks, package) of lines: what is found in each as bits, and the package that an added line imports.

    Patterns go over a batch's lines of their side at once, by an engine whose time grows with the text alone.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        line = batch.column(1)
        starts = lambda x: pc.fill_null(pc.starts_with(line, x), False).to_numpy(zero_copy_only=False)  # noqa: B023, E731
        added, removed = starts("+") & ~starts("+++"), starts("-") & ~starts("---")
        places = {k: np.flatnonzero(v) for k, v in (("added", added), ("removed", removed), ("both", added | removed), ("file", starts("diff --git a/")))}
        texts = {k: pc.utf8_slice_codeunits(line.take(pa.array(v)), 1) for k, v in places.items() if k != "file"}
        texts["file"] = pc.struct_field(pc.extract_regex(line.take(pa.array(places["file"])), r"^diff --git a/.+ b/(?P<file>[^\r\n]+)\r?$"), 0)
        marks = np.zeros(len(line), np.int64)
        for bit, (_, side, p) in enumerate(_searched()):
            found = pc.fill_null(pc.match_substring_regex(texts[side], p), False).to_numpy(zero_copy_only=False)
            marks[places[side][found]] |= 1 << bit
        named = pc.struct_field(pc.extract_regex(texts["added"], r"^\s*(?:import|from)\s+(?P<package>[a-zA-Z_][a-zA-Z0-9_]*)"), 0)
        foreign = pc.if_else(pc.is_in(named, value_set=pa.array(STDLIB, named.type)), pa.scalar(None, named.type), named)
        package = np.full(len(line), None, object)
        package[places["added"]] = foreign.to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks), pa.array(package, pa.string())], ["commit_sha", "marks", "package"])


def hits(lines: DataFrame) -> DataFrame:
    """One row per commit with the number of hits of each signal. lines: commit_sha, line; null lines count for nothing."""
    own = spread(lines).select("commit_sha", "line")
    kind = StructType([own.schema["commit_sha"], StructField("marks", LongType()), StructField("package", StringType())])
    has = lambda bit: F.col("marks").bitwiseAND(F.lit(1 << bit)) != 0
    counts = [F.count_if(has(bit)).alias(s) for bit, (s, _, _) in enumerate(_searched())]
    got = own.mapInArrow(_marks, kind).groupBy("commit_sha").agg(*counts, F.count_distinct("package").alias("_packages"))
    return got.select(
        "commit_sha", *SIGNALS, *FILE_SIGNALS, *[F.when(F.col("_manifests") > 0, F.col(s)).otherwise(0).alias(s) for s in MANIFEST_SIGNALS],
        F.greatest(F.col("_removed_logs") - F.col("_added_logs"), F.lit(0)).alias("net_log_decrease"), (F.col("_packages") + F.col("_required")).alias("new_third_party_lib"),
    )


def _per_hit() -> dict[str, tuple[str, float, float]]:
    table = {s: (v[0], v[1], v[2]) for s, v in (SIGNALS | FILE_SIGNALS | MANIFEST_SIGNALS).items()}
    return table | {"net_log_decrease": LOG_SIGNAL[:3], "new_third_party_lib": LIBRARY_SIGNAL}


def vectors(counted: DataFrame, overrides: dict[str, dict] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """commit_sha and one score per vector: the weighted mean of its enabled signals, each capped at 1, 4 decimals.

    counted: as ``hits`` gives it, with the columns callers, transitive, endpoints and policies where the graph is known.
    overrides: by signal, enabled and weight; keep: columns of ``counted`` that go along, as far as there are any.
    """
    overrides = overrides or {}
    value = {s: F.least(F.lit(1.0), F.col(s) * per) for s, (_, _, per) in _per_hit().items()}
    weight = {s: (v, w) for s, (v, w, _) in _per_hit().items()} | GRAPH_SIGNALS
    known = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in counted.columns else F.lit(0)
    value["endpoint_exposed"] = F.least(F.lit(1.0), known("endpoints") * 0.2)
    value["policy_violation"] = F.least(F.lit(1.0), known("policies") * 0.25)
    value["high_fan_in"] = F.when(known("callers") >= FAN_IN_FROM, F.least(F.lit(1.0), (known("callers") - FAN_IN_FROM) / 20 + 0.3)).otherwise(0.0)
    value["high_transitive_blast"] = F.when(known("transitive") >= BLAST_FROM, F.least(F.lit(1.0), (known("transitive") - BLAST_FROM) / 40 + 0.25)).otherwise(0.0)
    out = []
    for vector in VECTOR_WEIGHTS:
        own = [(s, overrides.get(s, {}).get("weight", w)) for s, (v, w) in weight.items() if v == vector and overrides.get(s, {}).get("enabled", True)]
        total = sum(w for _, w in own)
        score = reduce(lambda a, b: a + b, (value[s] * w for s, w in own)) / total if total else F.lit(0.0)
        out.append(F.round(F.least(F.lit(1.0), score), 4).alias(vector))
    return counted.select("commit_sha", *out, *[c for c in keep if c in counted.columns])


# What each touched node adds to the risk of the graph, and the shares of vectors and graph.
GRAPH_RISK = {"direct": 0.04, "callers": 0.02, "transitive": 0.01, "endpoints": 0.10, "policies": 0.05}
VECTOR_SHARE, GRAPH_SHARE = 0.7, 0.3


def risk(scored: DataFrame, graph: DataFrame | None = None) -> DataFrame:
    """commit_sha and risk: the weighted mean of the vectors and the size of the touched graph by their shares; 1 at most, 4 decimals.

    scored: as of ``vectors``; graph: commit_sha and those columns of ``GRAPH_RISK`` that are known and that ``scored`` doesn't hold
    itself. What isn't known counts as 0.
    """
    total = sum(VECTOR_WEIGHTS.values())
    mean = F.round(F.least(F.lit(1.0), reduce(lambda a, b: a + b, (F.col(v) * w for v, w in VECTOR_WEIGHTS.items())) / total), 4)
    joined = [c for c in GRAPH_RISK if graph is not None and c in graph.columns and c not in scored.columns]
    both = scored.join(graph.select("commit_sha", *joined), "commit_sha", "left") if joined else scored
    known = [c for c in GRAPH_RISK if c in both.columns]
    size = reduce(lambda a, b: a + b, (F.coalesce(F.col(c), F.lit(0)) * GRAPH_RISK[c] for c in known), F.lit(0.0))
    return both.select("commit_sha", F.round(F.least(F.lit(1.0), mean * VECTOR_SHARE + F.least(F.lit(1.0), size) * GRAPH_SHARE), 4).alias("risk"))
