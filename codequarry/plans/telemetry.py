"""Queries over steps of sessions, savings, insights, scans and files: windows up to the next event, stages, labels and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.functions.times import iso_ms
from codequarry.plans import model, wiring
from codequarry.plans.activity import _CTE, _INS, _MS, _calls, _turns
from codequarry.tables import read

#: Calls that a search without the graph would take, and tokens that each puts out.
BASELINE_CALLS, TOKENS_PER_CALL = 10, 150
SCOPES = ("module", "class", "method")
STAGES = (("parsing", "pars"), ("wiring", "wir"), ("scoring", "hygiene"), ("matching", "pattern"), ("summing up", "summar"))


def category(name: Column) -> Column:
    """The kind of a tool by its name: the first of the lists that holds a part of it, else other; a null name is none."""
    low = F.lower(F.coalesce(name, F.lit("")))
    rules = (("graph", "query|cypher|graph"), ("index", "index"), ("write", "draft|edit|write"), ("search", "grep|find|search|batch"))
    out = F.when(low == "", "none")
    for kind, words in rules:
        out = out.when(low.rlike(words), kind)
    return out.otherwise("other")


def tool_categories(spark: SparkSession, d: str) -> DataFrame:
    c = _calls(spark, d, "source", "error")
    return c.groupBy(category(F.col("source")).alias("category")).agg(F.count("*").alias("n"), F.count("error").alias("n_errors"))


def events_to_next_purchase(spark: SparkSession, d: str) -> DataFrame:
    """For each click of a user the number of events up to the first purchase that follows; none where none does."""
    e = read(spark, d, "events", "event_id", "ts", "user_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.row_number().over(w)
    numbered = e.withColumn("at", at)
    following = F.min(F.when(F.col("event_type") == "purchase", F.col("at"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    return numbered.withColumn("goal", following).where("event_type = 'click' and goal is not null").select("event_id", "user_id", (F.col("goal") - F.col("at") - 1).cast("long").alias("n_between"))


def loop_of_first_hit(spark: SparkSession, d: str) -> DataFrame:
    """The loop of each session in which more than three tools were first called; a loop begins at a turn with tools after one without."""
    t = _turns(spark, d, "tool_call_count").withColumn("tools", F.coalesce("tool_call_count", F.lit(0)))
    w = Window.partitionBy("session_id").orderBy("ms", "turn_id")
    begins = (F.col("tools") > 0) & ~F.coalesce(F.lag("tools").over(w) > 0, F.lit(False))
    looped = t.withColumn("loop", F.sum(begins.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return looped.where("tools > 3").groupBy("session_id").agg(F.min(F.struct("ms", "turn_id", "loop"))["loop"].alias("loop"))


def session_savings(spark: SparkSession, d: str) -> DataFrame:
    """Tool calls before the first busy turn of a session, and what is saved against a search of ten calls: their output and cache reads."""
    t = _turns(spark, d, "tool_call_count", "cache_read_tokens").withColumn("tools", F.coalesce("tool_call_count", F.lit(0)))
    first = F.min(F.when(F.col("tools") > 3, F.col("ms"))).over(Window.partitionBy("session_id"))
    got = t.withColumn("first", first).groupBy("session_id").agg(F.sum(F.when(F.col("ms") < F.col("first"), F.col("tools")).otherwise(0)).alias("before"), F.sum("tools").alias("n"), F.sum(F.coalesce("cache_read_tokens", F.lit(0))).alias("cache"), F.max("first").alias("first")).where("first is not null")
    saved = F.greatest(F.lit(0), BASELINE_CALLS - F.col("before"))
    return got.select("session_id", "before", saved.cast("long").alias("saved_calls"), F.round(saved * (TOKENS_PER_CALL + F.col("cache") / F.greatest("n", F.lit(1))), 0).cast("long").alias("saved_tokens"))


def cached_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of cached tokens in each session's first turn, in per cent, no division by zero."""
    t = _turns(spark, d, "input_tokens", "cache_read_tokens")
    w = Window.partitionBy("session_id").orderBy("ms", "turn_id")
    first = t.withColumn("k", F.row_number().over(w)).where("k = 1")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return first.select("session_id", F.round(zero("cache_read_tokens") * 100 / F.greatest(zero("input_tokens") + zero("cache_read_tokens"), F.lit(1)), 1).alias("cached_pct"))


def _insights(spark, d):
    t = _turns(spark, d, "insights_raw").where(F.col("insights_raw").startswith("["))
    x = t.select("turn_id", F.explode(F.from_json("insights_raw", "array<struct<scope:string,applies_to:string,confidence:double>>")).alias("x"))
    return x.select("turn_id", "x.scope", "x.applies_to", "x.confidence")


def insight_groups(spark: SparkSession, d: str) -> DataFrame:
    """Insights by scope in its fixed order, then by what they apply to: how many, the best, and the turns."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SCOPES)), F.col("scope")), F.lit(0).cast("long")), F.lit(len(SCOPES) + 1).cast("long"))
    got = _insights(spark, d).groupBy("scope", "applies_to").agg(F.count("*").alias("n"), F.round(F.max("confidence"), 2).alias("best"), F.array_join(F.sort_array(F.collect_set("turn_id")), ",").alias("turns"))
    return got.select(rank.alias("place"), "scope", "applies_to", "n", "best", "turns")


def insights_of_modules(spark: SparkSession, d: str) -> DataFrame:
    """Insights sure enough whose target lies in a package, dotted or with slashes, by package; those of the surest half count."""
    i = _insights(spark, d).where("confidence >= 0.75")
    package = F.regexp_extract(F.replace("applies_to", F.lit("/"), F.lit(".")), r"([a-z]+\.[a-z]+\.[a-z]+)", 1)
    return i.select(package.alias("package"), "turn_id").where("package <> ''").groupBy("package").agg(F.count("*").alias("n"), F.countDistinct("turn_id").alias("n_turns"))


def scan_stages(spark: SparkSession, d: str) -> DataFrame:
    """State of each stage of a scan by what its log tells: done if a later one began, running if it is the last, else waiting."""
    s = read(spark, d, "scan_log", "id", "logs").where("logs is not null")
    low = F.lower("logs")
    rows = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(name).alias("stage"), (F.instr(low, word) > 0).alias("begun")) for k, (name, word) in enumerate(STAGES)])
    each = s.select("id", rows.alias("rows")).distinct().select("id", F.inline("rows"))  # repeated rows are told apart by the stages
    last = F.max(F.when(F.col("begun"), F.col("place"))).over(Window.partitionBy("id"))
    return each.withColumn("last", last).select("id", "stage", F.when(F.col("begun") & (F.col("place") < F.col("last")), "done").when(F.col("begun"), "running").otherwise("waiting").alias("state"))


def scan_refreshed(spark: SparkSession, d: str) -> DataFrame:
    """One row per scan: kind, repository and start as first delivered, status and exit code as last; a finished form is later."""
    s = read(spark, d, "scan_log", "id", "repo_id", "scan_type", "started_at", "finished_at", "status", "exit_code").distinct()
    order = F.struct(F.col("finished_at").isNotNull().alias("done"), F.coalesce(iso_ms(F.col("finished_at")), F.lit(0)).alias("ms"), F.coalesce("status", F.lit("")).alias("status"))
    return s.groupBy("id").agg(F.min_by("scan_type", order).alias("scan_type"), F.min_by(iso_ms(F.col("started_at")), order).alias("started_ms"), F.max_by("status", order).alias("status"), F.max_by("exit_code", order).alias("exit_code"))


def scan_freshness(spark: SparkSession, d: str) -> DataFrame:
    """Repositories by the age of their last good scan against the newest of all: fresh within an hour, else stale, or never scanned."""
    s = read(spark, d, "scan_log", "repo_id", "finished_at", "exit_code").where("repo_id is not null").distinct()
    last = s.groupBy("repo_id").agg(F.max(F.when(F.col("exit_code") == 0, iso_ms(F.col("finished_at")))).alias("ms"))
    newest = last.agg(F.max("ms").alias("newest"))
    age = F.col("newest") - F.col("ms")
    return last.crossJoin(F.broadcast(newest)).select("repo_id", F.when(F.col("ms").isNull(), "never").when(age > 3_600_000, "stale").otherwise("fresh").alias("state"))  # one row


def file_names(spark: SparkSession, d: str) -> DataFrame:
    """Names made of paths: the dotted module of a Python file, a slug, a title, and the symbol of a file."""
    p = F.col("file_path")
    f = read(spark, d, "source_files", "file_path").where("file_path is not null").distinct()
    inner = F.regexp_replace(p, r"^/(?:repos|workspace/src)/[^/]+/", "")
    dotted = F.replace(F.regexp_replace(F.regexp_replace(inner, r"\.py$", ""), "/__init__$", ""), F.lit("/"), F.lit("."))
    stem = F.regexp_replace(F.substring_index(p, "/", -1), r"\.[^.]*$", "")
    title = F.initcap(F.replace(F.regexp_replace(stem, r"([a-z0-9])([A-Z])", "$1 $2"), F.lit("_"), F.lit(" ")))
    return f.select("file_path", F.when(p.endswith(".py"), dotted).alias("module"), F.replace(inner, F.lit("/"), F.lit("--")).alias("slug"), title.alias("title"), F.concat(F.lit("file "), F.replace(inner, F.lit(" "), F.lit("  ")), F.lit("/")).alias("symbol"))


def source_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Characters of each class: of its file if that is there, else fifty for each line, and tokens at four characters."""
    c = read(spark, d, "symbols", "symbol_id", "repo_id", "kind", "file_path", "start_line", "end_line").where("kind = 'class'").dropDuplicates(["symbol_id"])
    n = read(spark, d, "source_files", "repo_id", "file_path", "content").groupBy("repo_id", "file_path").agg(F.max(F.length("content")).alias("chars"))
    chars = F.coalesce(F.nullif("chars", F.lit(0)), F.greatest(F.lit(0), F.col("end_line") - F.col("start_line")) * 50, F.lit(0))
    return c.join(n, ["repo_id", "file_path"], "left").select("symbol_id", chars.cast("long").alias("source_chars"), F.floor(chars / 4).alias("tokens"))


def empty_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Documents that say nothing: a body of fewer than 80 characters without headings, or a placeholder at its beginning."""
    docs = read(spark, d, "documents", "source", "text")
    text = F.coalesce("text", F.lit(""))
    body = F.trim(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.startswith("#")), "\n"))
    sentinel = F.lower(F.substring(text, 1, 200)).rlike("no data|not available|todo|placeholder")
    return docs.groupBy("source").agg(F.count_if(F.length(body) < 80).alias("n_short"), F.count_if(sentinel).alias("n_placeholder"), F.count_if((F.length(body) < 80) | sentinel).alias("n_empty"))


def untagged_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose language isn't tagged as English or not at all: a null counts as different."""
    return read(spark, d, "documents", "source", "lang").where(F.col("lang").isNull() | (F.col("lang") != "en")).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang").isNull()).alias("n_null"))


def coverage_labels(spark: SparkSession, d: str) -> DataFrame:
    """Classes of the derived graph by how many tests bear their name: none, partial below three, else good."""
    cls = model.classes(spark, d).where("not endswith(name, 'Test') and not endswith(name, 'Spec')").select("repo_id", "fqn")
    n = cls.join(wiring.tests_by_name(spark, d), ["repo_id", "fqn"], "left").withColumn("n", F.coalesce("n_tests", F.lit(0)))
    return n.groupBy("repo_id", F.when(F.col("n") == 0, "none").when(F.col("n") < 3, "partial").otherwise("good").alias("coverage")).agg(F.count("*").alias("n"))


def prompt_heads(spark: SparkSession, d: str) -> DataFrame:
    """The first 80 characters of each prompt, and whether it goes on."""
    t = _turns(spark, d, "user_prompt").where("user_prompt is not null")
    return t.select("turn_id", F.left("user_prompt", F.lit(80)).alias("head"), (F.length("user_prompt") > 80).alias("cut"))


QUERIES = {f.__name__: f for f in (
    tool_categories, events_to_next_purchase, loop_of_first_hit, session_savings, cached_share, insight_groups, insights_of_modules, scan_stages, scan_refreshed, scan_freshness, file_names, source_sizes, empty_bodies, untagged_documents, coverage_labels, prompt_heads,
)}

_INNER = "regexp_replace(file_path, '^/(?:repos|workspace/src)/[^/]+/', '')"
_STEM = "regexp_replace(split_part(file_path, '/', -1), '\\.[^.]*$', '')"
_BODY = "trim(array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT starts_with(x, '#')), chr(10)))"
_SENT = "regexp_matches(lower(coalesce(text, '')[1:200]), 'no data|not available|todo|placeholder')"
_FIN = _MS.format("finished_at")
SQL = {k: _CTE + v for k, v in {
    "tool_categories": "SELECT CASE WHEN source IS NULL OR source = '' THEN 'none' WHEN regexp_matches(lower(source), 'query|cypher|graph') THEN 'graph' WHEN regexp_matches(lower(source), 'index') THEN 'index' WHEN regexp_matches(lower(source), 'draft|edit|write') THEN 'write' WHEN regexp_matches(lower(source), 'grep|find|search|batch') THEN 'search' ELSE 'other' END AS category, count(*) AS n, count(error) AS n_errors FROM c GROUP BY ALL",
    "events_to_next_purchase": ", e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS at_ FROM events) SELECT event_id, user_id, (SELECT min(p.at_) FROM e p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.at_ > e.at_) - at_ - 1 AS n_between FROM e WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM e p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.at_ > e.at_)",
    "loop_of_first_hit": ", a AS (SELECT *, coalesce(tool_call_count, 0) AS tools, lag(coalesce(tool_call_count, 0)) OVER (PARTITION BY session_id ORDER BY ms, turn_id) AS prev FROM t), b AS (SELECT *, sum(CASE WHEN tools > 0 AND NOT coalesce(prev > 0, false) THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ms, turn_id ROWS UNBOUNDED PRECEDING) AS loop, row_number() OVER (PARTITION BY session_id ORDER BY tools > 3 DESC, ms, turn_id) AS k FROM a) SELECT session_id, CAST(loop AS BIGINT) AS loop FROM b WHERE k = 1 AND tools > 3",
    "session_savings": ", a AS (SELECT session_id, ms, coalesce(tool_call_count, 0) AS tools, coalesce(cache_read_tokens, 0) AS cr, min(CASE WHEN tool_call_count > 3 THEN ms END) OVER (PARTITION BY session_id) AS f FROM t), b AS (SELECT session_id, CAST(sum(CASE WHEN ms < f THEN tools ELSE 0 END) AS BIGINT) AS before, sum(tools) AS n, sum(cr) AS cache FROM a WHERE f IS NOT NULL GROUP BY 1) SELECT session_id, before, greatest(0, 10 - before) AS saved_calls, CAST(round(greatest(0, 10 - before) * (150 + cache / greatest(n, 1)), 0) AS BIGINT) AS saved_tokens FROM b",
    "cached_share": "SELECT session_id, round(coalesce(cache_read_tokens, 0) * 100 / greatest(coalesce(input_tokens, 0) + coalesce(cache_read_tokens, 0), 1), 1) AS cached_pct FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ms, turn_id) AS k FROM t) WHERE k = 1",
    "insight_groups": _INS + ", i AS (SELECT turn_id, json_extract_string(x, '$.scope') AS scope, json_extract_string(x, '$.applies_to') AS applies_to, CAST(json_extract_string(x, '$.confidence') AS DOUBLE) AS confidence FROM x) SELECT CASE scope WHEN 'module' THEN 1 WHEN 'class' THEN 2 WHEN 'method' THEN 3 ELSE 4 END AS place, scope, applies_to, count(*) AS n, round(max(confidence), 2) AS best, array_to_string(list_sort(list(DISTINCT turn_id)), ',') AS turns FROM i GROUP BY ALL",
    "insights_of_modules": _INS + ", i AS (SELECT turn_id, regexp_extract(replace(json_extract_string(x, '$.applies_to'), '/', '.'), '([a-z]+\\.[a-z]+\\.[a-z]+)', 1) AS package FROM x WHERE CAST(json_extract_string(x, '$.confidence') AS DOUBLE) >= 0.75) SELECT package, count(*) AS n, count(DISTINCT turn_id) AS n_turns FROM i WHERE package <> '' GROUP BY package",
    "scan_stages": ", a AS (SELECT DISTINCT id, lower(logs) AS l FROM scan_log WHERE logs IS NOT NULL), b AS (SELECT id, 0 AS p, 'parsing' AS stage, contains(l, 'pars') AS g FROM a UNION ALL SELECT id, 1, 'wiring', contains(l, 'wir') FROM a UNION ALL SELECT id, 2, 'scoring', contains(l, 'hygiene') FROM a UNION ALL SELECT id, 3, 'matching', contains(l, 'pattern') FROM a UNION ALL SELECT id, 4, 'summing up', contains(l, 'summar') FROM a) SELECT id, stage, CASE WHEN g AND p < max(CASE WHEN g THEN p END) OVER (PARTITION BY id) THEN 'done' WHEN g THEN 'running' ELSE 'waiting' END AS state FROM b",
    "scan_refreshed": f", s2 AS (SELECT DISTINCT id, scan_type, {_MS.format('started_at')} AS a, finished_at IS NOT NULL AS done, coalesce({_FIN}, 0) AS m, status, exit_code FROM scan_log) SELECT id, arg_min(scan_type, o) AS scan_type, arg_min(a, o) AS started_ms, arg_max(status, o) AS status, arg_max(exit_code, o) AS exit_code FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY done, m, coalesce(status, '')) AS o FROM s2) GROUP BY id",
    "scan_freshness": f", l2 AS (SELECT repo_id, max(CASE WHEN exit_code = 0 THEN {_FIN} END) AS m FROM scan_log WHERE repo_id IS NOT NULL GROUP BY 1) SELECT repo_id, CASE WHEN m IS NULL THEN 'never' WHEN (SELECT max(m) FROM l2) - m > 3600000 THEN 'stale' ELSE 'fresh' END AS state FROM l2",
    "file_names": f"SELECT DISTINCT file_path, CASE WHEN file_path LIKE '%.py' THEN replace(regexp_replace(regexp_replace({_INNER}, '\\.py$', ''), '/__init__$', ''), '/', '.') END AS module, replace({_INNER}, '/', '--') AS slug, array_to_string(list_transform(string_split(replace(regexp_replace({_STEM}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title, 'file ' || replace({_INNER}, ' ', '  ') || '/' AS symbol FROM source_files WHERE file_path IS NOT NULL",
    "source_sizes": "SELECT symbol_id, coalesce(nullif(chars, 0), greatest(0, end_line - start_line) * 50, 0) AS source_chars, CAST(floor(coalesce(nullif(chars, 0), greatest(0, end_line - start_line) * 50, 0) / 4.0) AS BIGINT) AS tokens FROM (SELECT DISTINCT ON (symbol_id) * FROM symbols WHERE kind = 'class') LEFT JOIN (SELECT repo_id, file_path, max(length(content)) AS chars FROM source_files GROUP BY ALL) USING (repo_id, file_path)",
    "empty_bodies": f"SELECT source, count(*) FILTER (length({_BODY}) < 80) AS n_short, count(*) FILTER ({_SENT}) AS n_placeholder, count(*) FILTER (length({_BODY}) < 80 OR {_SENT}) AS n_empty FROM documents GROUP BY source",
    "untagged_documents": "SELECT source, count(*) AS n, count(*) FILTER (lang IS NULL) AS n_null FROM documents WHERE lang IS NULL OR lang <> 'en' GROUP BY source",
    "prompt_heads": "SELECT turn_id, user_prompt[1:80] AS head, length(user_prompt) > 80 AS cut FROM t WHERE user_prompt IS NOT NULL",
}.items()}
SQL["coverage_labels"] = model.CTE + ", n AS (SELECT c.repo_id, c.fqn, (SELECT count(DISTINCT t.fqn) FROM cls t WHERE t.repo_id = c.repo_id AND contains(t.name, c.name) AND regexp_matches(t.name, '(Test|Spec)$')) AS n FROM cls c WHERE NOT regexp_matches(name, '(Test|Spec)$')) SELECT repo_id, CASE WHEN n = 0 THEN 'none' WHEN n < 3 THEN 'partial' ELSE 'good' END AS coverage, count(*) AS n FROM n GROUP BY ALL"
