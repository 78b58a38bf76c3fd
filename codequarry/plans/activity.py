"""Queries over sessions, turns, calls, scans, documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.functions.times import iso_ms
from codequarry.operators import closure, paths, signals
from codequarry.plans.code import imported
from codequarry.tables import cut, read

_MS = "CAST(epoch_ms(CAST(CASE WHEN regexp_matches({0}, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') THEN {0} ELSE {0} || 'Z' END AS TIMESTAMPTZ)) AS BIGINT)"
_CTE = f"""WITH t AS (SELECT DISTINCT *, {_MS.format("ts")} AS ms FROM turns), s AS (SELECT DISTINCT *, {_MS.format("started_at")} AS a, {_MS.format("last_seen")} AS b FROM sessions),
c AS (SELECT DISTINCT *, {_MS.format("ts")} AS ms FROM llm_calls), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
"""


def _turns(spark, d, *columns):
    return read(spark, d, "turns", "turn_id", "session_id", "ts", *columns).distinct().withColumn("ms", iso_ms(F.col("ts")))


def _calls(spark, d, *columns):
    return read(spark, d, "llm_calls", "id", "ts", *columns).distinct().withColumn("ms", iso_ms(F.col("ts")))


def session_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with turns, tokens and tool calls, those without turns among them."""
    s = read(spark, d, "sessions").distinct()
    t = _turns(spark, d, "input_tokens", "output_tokens", "tool_call_count").groupBy("session_id").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"), F.sum("tool_call_count").alias("c"))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return s.join(t, "session_id", "left").select("session_id", F.coalesce("client", F.lit("?")).alias("client"), zero("n", "n_turns"), zero("i", "input_tokens"), zero("o", "output_tokens"), zero("c", "tool_calls"))


def client_stats(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "sessions").distinct()
    ms = iso_ms(F.col("last_seen")) - iso_ms(F.col("started_at"))
    return s.groupBy(F.coalesce("client", F.lit("?")).alias("client")).agg(F.count("*").alias("n"), F.countDistinct("cwd").alias("n_dirs"), F.max(ms).alias("longest_ms"))


def first_turn(spark: SparkSession, d: str) -> DataFrame:
    """The first turn of each session that has a prompt."""
    t = _turns(spark, d, "user_prompt").where("trim(user_prompt) <> ''")
    w = Window.partitionBy("session_id").orderBy("ms", "turn_id")
    return t.withColumn("k", F.row_number().over(w)).where("k = 1").select("session_id", "turn_id", "ms")


def step_token_delta(spark: SparkSession, d: str) -> DataFrame:
    """Cost of each turn in tokens: what the caches grew by, and the output."""
    t = _turns(spark, d, "cache_read_tokens", "cache_creation_tokens", "output_tokens")
    w = Window.partitionBy("session_id").orderBy("ms", "turn_id")
    now = lambda c: F.coalesce(F.col(c), F.lit(0))
    grown = lambda c: now(c) - F.lag(now(c), 1, 0).over(w)
    return t.select("turn_id", "session_id", (grown("cache_read_tokens") + grown("cache_creation_tokens") + now("output_tokens")).cast("long").alias("step_tokens"))


def agent_loops(spark: SparkSession, d: str) -> DataFrame:
    """Loops of a session: a turn with tools after one without begins a new one."""
    t = _turns(spark, d, "tool_call_count").withColumn("tools", F.coalesce("tool_call_count", F.lit(0)) > 0)
    w = Window.partitionBy("session_id").orderBy("ms", "turn_id")
    begins = F.col("tools") & ~F.coalesce(F.lag("tools").over(w), F.lit(False))
    loops = t.withColumn("loop", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("tools")
    return loops.groupBy("session_id", "loop").agg(F.count("*").alias("n_turns"), F.sum("tool_call_count").alias("n_tools"))


def first_event_split(spark: SparkSession, d: str) -> DataFrame:
    """Turns before and after the first one with more than three tool calls."""
    t = _turns(spark, d, "tool_call_count")
    own = Window.partitionBy("session_id")
    first = F.min(F.when(F.col("tool_call_count") > 3, F.col("ms"))).over(own)
    return t.withColumn("first", first).groupBy("session_id").agg(F.count_if(F.col("ms") < F.col("first")).alias("n_before"), F.count_if(F.col("ms") > F.col("first")).alias("n_after"), F.count_if(F.col("first").isNull()).alias("n_without"))


def gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Visits of users: events no more than 30 minutes apart."""
    e = read(spark, d, "events", "event_id", "ts", "user_id", "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp")) > 30 * 60 * 1_000_000, F.lit(True))
    visits = e.withColumn("visit", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return visits.groupBy("user_id", "visit").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour and type."""
    e = read(spark, d, "events", "ts", "event_type", "value")
    return e.groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


def rolling_24h(spark: SparkSession, d: str) -> DataFrame:
    """For each error the number of the user's events in the 24 hours up to it."""
    e = read(spark, d, "events", "event_id", "ts", "user_id", "event_type").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("s").rangeBetween(-24 * 3600 * 1_000_000, 0)
    return e.withColumn("n_24h", F.count("*").over(w)).where("event_type = 'error'").select("event_id", "user_id", "n_24h")


def nearest_event_match(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the user's nearest click within two hours."""
    e = read(spark, d, "events", "event_id", "ts", "user_id", "event_type").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    buys, clicks = (e.where(f"event_type = '{x}'").select("user_id", "event_id", "ms") for x in ("purchase", "click"))
    got = paths.nearest(buys, clicks, ["user_id"], "ms", "ms", 2 * 3600 * 1000)
    return got.select("event_id", F.col("near_event_id").alias("click_id"), "gap_ms")


def json_predicate_sum(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, d, "events", "event_type", "value", "props").where(k > 50).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("sum_k"))


def tool_error_rates(spark: SparkSession, d: str) -> DataFrame:
    """Calls, errors and percentage of errors by source, no division by zero."""
    c = _calls(spark, d, "source", "error")
    n, e = F.count("*"), F.count("error")
    return c.groupBy("source").agg(n.alias("n"), e.alias("n_errors"), F.round(e * 100 / F.greatest(n, F.lit(1)), 1).alias("error_pct"))


def tokens_by_model(spark: SparkSession, d: str) -> DataFrame:
    c = _calls(spark, d, "model", "input_tokens", "output_tokens", "cache_read_tokens", "cost_usd")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).alias(x)
    return c.groupBy("model").agg(F.count("*").alias("n"), total("input_tokens"), total("output_tokens"), total("cache_read_tokens"), F.round(F.sum(F.col("cost_usd").cast("decimal(18,8)")), 4).cast("double").alias("cost_usd"))


def cube_calls(spark: SparkSession, d: str) -> DataFrame:
    """Counts by model and whether a call failed, with both margins."""
    return _calls(spark, d, "model", "error").cube("model", F.col("error").isNotNull().alias("failed")).agg(F.count("*").alias("n"))


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """Calls by the attempt that their meta data name; unreadable and missing ones are attempt 0."""
    c = _calls(spark, d, "meta")
    k = F.coalesce(F.expr("try_cast(get_json_object(meta, '$.attempt') AS INT)"), F.lit(0))
    return c.groupBy(k.alias("attempt")).agg(F.count("*").alias("n"), F.count_if(F.get_json_object("meta", "$.stop_reason") == "max_tokens").alias("n_cut"))


def insight_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Insights out of JSON arrays by scope, the texts that are no JSON left out."""
    t = _turns(spark, d, "insights_raw").where(F.col("insights_raw").startswith("["))
    x = t.select("turn_id", F.explode(F.from_json("insights_raw", "array<struct<scope:string,applies_to:string,confidence:double>>")).alias("x"))
    return x.groupBy("x.scope").agg(F.count("*").alias("n"), F.countDistinct("x.applies_to").alias("n_targets"), F.round(F.max("x.confidence"), 2).alias("best"))


def insight_gate(spark: SparkSession, d: str) -> DataFrame:
    """Insights sure enough to be read, the surest three of each session."""
    t = _turns(spark, d, "insights_raw").where(F.col("insights_raw").startswith("["))
    x = t.select("turn_id", "session_id", F.posexplode(F.from_json("insights_raw", "array<struct<scope:string,applies_to:string,confidence:double>>")).alias("at", "x")).where("x.confidence >= 0.5")
    w = Window.partitionBy("session_id").orderBy(F.desc("x.confidence"), "turn_id", "at")
    return x.withColumn("k", F.row_number().over(w)).where("k <= 3").select("session_id", "k", F.col("x.applies_to").alias("applies_to"))


def later_turns_ageing(spark: SparkSession, d: str) -> DataFrame:
    """Staleness that grows by 0.2 for each later turn of the session, at most 1."""
    t = _turns(spark, d, "insights_raw")
    w = Window.partitionBy("session_id").orderBy(F.desc("ms"), F.desc("turn_id")).rowsBetween(Window.unboundedPreceding, -1)
    later = F.coalesce(F.count("*").over(w), F.lit(0))
    return t.withColumn("staleness", F.round(F.least(F.lit(1.0), later * 0.2), 1)).where("trim(insights_raw) <> ''").select("turn_id", "staleness")


# Words that are no search words.
STOP_WORDS = (
    "what where which how does the are is in of to a an for and or it this that with by do have has be at from on as if can get list show find about handle handles used using i we you me my want make put see also page same line just now only so but not all more"
).split()


def keyword_top3(spark: SparkSession, d: str) -> DataFrame:
    """The three best search words of each prompt: a capital at the beginning, an underscore and length count.

    Words that differ in case alone are one, the better one and then the first going before; of equal scores the first goes first.
    A prompt without such a word gives its first 20 characters up to a blank, a blank one the word ``<query>``.
    """
    t = _turns(spark, d, "user_prompt").where("user_prompt is not null")
    word = F.col("word")
    score = F.when(F.substring(word, 1, 1).rlike("[A-Z]"), 2).otherwise(0) + F.when(F.instr(word, "_") > 0, 2).otherwise(0) + F.when(F.length(word) >= 7, 2).when(F.length(word) >= 5, 1).otherwise(0)
    x = t.select("turn_id", F.posexplode(F.regexp_extract_all("user_prompt", F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))).alias("at", "word")).where((F.length("word") >= 3) & ~F.lower("word").isin(*STOP_WORDS)).withColumn("score", score)
    best = x.groupBy("turn_id", F.lower("word").alias("low")).agg(F.min(F.struct((-F.col("score")).alias("minus"), "at", "word")).alias("x"))
    w = Window.partitionBy("turn_id").orderBy("x.minus", "x.at")
    top = best.withColumn("k", F.row_number().over(w)).where("k <= 3").select("turn_id", "k", "x.word", (-F.col("x.minus")).alias("score"))
    first = F.split(F.trim("user_prompt"), r"\s+")[0]
    rest = t.join(top.select("turn_id").distinct(), "turn_id", "left_anti").select("turn_id", F.lit(1).alias("k"), F.when(first == "", "<query>").otherwise(F.substring(first, 1, 20)).alias("word"), F.lit(0).alias("score"))
    return top.unionByName(rest)


def question_classes(spark: SparkSession, d: str) -> DataFrame:
    """Prompts by the kind of question that their words tell."""
    low = F.lower(F.coalesce("user_prompt", F.lit("")))
    kind = F.when(F.trim(low) == "", "blank").when(low.rlike("who calls|callers? of|depend on|depends on"), "graph").when(low.rlike("tests? that|cover"), "tests").when(low.rlike("safe to remove|changed"), "impact").otherwise("other")
    return _turns(spark, d, "user_prompt").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def log_classes(spark: SparkSession, d: str) -> DataFrame:
    """Lines of scan logs by what they tell, and whether a scan is a storm of errors."""
    lines = F.split("logs", r"\r\n|\n|\r")
    holds = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p))).cast("long")
    s = read(spark, d, "scan_log", "id", "logs").where("logs is not null").select("id", F.xxhash64("logs").alias("h"), F.size(lines).cast("long").alias("n"), holds("(?i)\\b(error|fatal|critical)\\b").alias("n_errors"), holds("(?i)\\bwarn(ing)?\\b").alias("n_warnings"), holds("^\\s*at |^Traceback|Exception").alias("n_traces")).distinct()
    got = s.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("n", "n_errors", "n_warnings", "n_traces")])  # different logs of one scan add up
    return got.withColumn("storm", F.col("n_errors") * 2 > F.col("n"))


def scan_progress(spark: SparkSession, d: str) -> DataFrame:
    """The last number of parsed files that a log tells."""
    found = F.regexp_extract_all("logs", F.lit(r"Parsed (\d+) files"), F.lit(1))
    s = read(spark, d, "scan_log", "id", "logs").where("logs is not null")
    return s.select("id", F.size(found).cast("long").alias("n_steps"), F.try_element_at(found, F.lit(-1)).cast("long").alias("last_parsed")).where("n_steps > 0").distinct()


def scan_status(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "scan_log", "id", "scan_type", "status", "exit_code").distinct()
    return s.groupBy("scan_type", F.coalesce("status", F.lit("?")).alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("exit_code") != 0).alias("n_failed"))


def _diff(spark, d):
    """Documents as diffs: every line whose number is odd is added, the others removed, names as they stand."""
    docs = read(spark, d, "documents", "doc_id", "text").where("text is not null")
    lines = docs.select(F.col("doc_id").alias("commit_sha"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return lines.select("commit_sha", F.concat(F.when(F.col("at") % 2 == 0, "+").otherwise("-"), "line").alias("line"))


def _around(spark, d):
    """(commit_sha, direct, callers, transitive, endpoints): of the classes that a document names, how many these, their importers and theirs are."""
    docs = read(spark, d, "documents", F.col("doc_id").alias("commit_sha"), "text").where("text is not null")
    names = docs.select("commit_sha", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b"), F.lit(1)))).alias("name"))
    cls = read(spark, d, "symbols", "display_name", "kind", "file_path").where("kind = 'class'").select(F.col("display_name").alias("name"), "file_path").distinct()
    found = imported(spark, d, True).select("file_path", "target").distinct()
    uses = found.join(cls, "file_path").where("name <> target").select(F.col("target").alias("dst"), F.col("name").alias("src")).distinct()
    direct = cut(names.join(cls.select("name").distinct(), "name").distinct())
    counted = direct.groupBy("commit_sha").agg(F.count("*").alias("direct"), F.count_if(F.col("name").rlike("(Controller|Client)$")).alias("endpoints"))
    further = closure.importers(uses, direct.select(F.col("commit_sha").alias("key"), F.col("name").alias("node"))).withColumnRenamed("key", "commit_sha")
    return counted.join(further, "commit_sha", "left")


def _graphed(spark, d):
    return signals.hits(_diff(spark, d)).join(_around(spark, d), "commit_sha", "left")


def signal_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hits of five signals in each document read as a diff."""
    return signals.hits(_diff(spark, d)).select("commit_sha", "crypto_function_changed", "retry_pattern_changed", "db_query_changed", "async_model_changed", "net_log_decrease")


def vector_scores(spark: SparkSession, d: str) -> DataFrame:
    """The six vectors of each document read as a diff, with the graph around the classes that it names."""
    return signals.vectors(_graphed(spark, d))


def commit_risk(spark: SparkSession, d: str) -> DataFrame:
    """The risk of each such commit: seven tenths by its vectors, three by the size of the graph that it touches."""
    return signals.risk(signals.vectors(_graphed(spark, d), keep=tuple(signals.GRAPH_RISK)))


def changed_lines(spark: SparkSession, d: str) -> DataFrame:
    added, removed, _ = signals.sides(F.col("line"))
    return _diff(spark, d).groupBy("commit_sha").agg(F.count_if(added).alias("n_added"), F.count_if(removed).alias("n_removed"))


def reference_targets(spark: SparkSession, d: str) -> DataFrame:
    """What documents refer to: targets of Markdown links and HTML references, in-page ones left out, and dotted names."""
    docs = read(spark, d, "documents", "doc_id", "text").where("text is not null")
    patterns = (r"\]\(([^)\s#][^)\s]*)\)", "(?:href|src|action)=\"([^\"#][^\"]*)\"", r"\b([a-z]+(?:\.[a-z]+){2,}(?:\.[A-Z]\w*)?)")
    found = F.array_distinct(F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in patterns]))
    return docs.select("doc_id", F.explode(found).alias("target")).groupBy("target").agg(F.countDistinct("doc_id").alias("n_docs"))


def mentioned_classes(spark: SparkSession, d: str) -> DataFrame:
    """Class names that documents mention and no class bears: dangling references."""
    docs = read(spark, d, "documents", "doc_id", "text").where("text is not null")
    names = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b"), F.lit(1)))).alias("name"))
    known = read(spark, d, "symbols", F.col("display_name").alias("name"), "kind").where("kind = 'class'").select("name").distinct()
    return names.join(known, "name", "left_anti").groupBy("name").agg(F.count("*").alias("n_docs"))


def body_emptiness(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose body, headings left out, is too short to say anything."""
    docs = read(spark, d, "documents", "doc_id", "source", "text")
    body = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: ~x.startswith("#") & (F.trim(x) != "")), "\n")
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.length(body) < 80).alias("n_empty"))


def source_languages(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the language that their tag means, whatever its spelling."""
    low = F.lower(F.trim(F.coalesce("lang", F.lit("und"))))
    code = F.when(low.rlike("^en"), "en").when(low.rlike("^de"), "de").when(low.rlike("^fr"), "fr").when(low.rlike("^(es|spa)"), "es").otherwise("und")
    return read(spark, d, "documents", "doc_id", "lang", "n_chars").groupBy(code.alias("code")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


QUERIES = {f.__name__: f for f in (
    session_rollup, client_stats, first_turn, step_token_delta, agent_loops, first_event_split, gap_sessions, event_windows, rolling_24h, nearest_event_match, json_predicate_sum, tool_error_rates, tokens_by_model, cube_calls, attempts, insight_scopes, insight_gate, later_turns_ageing, keyword_top3, question_classes,
    log_classes, scan_progress, scan_status, signal_counts, vector_scores, commit_risk, changed_lines, reference_targets, mentioned_classes, body_emptiness, source_languages,
)}

_INS = ", x AS (SELECT turn_id, session_id, generate_subscripts(j, 1) - 1 AS at_, unnest(j) AS x FROM (SELECT turn_id, session_id, CAST(insights_raw AS JSON[]) AS j FROM t WHERE starts_with(insights_raw, '[')))"
_DIFF = ", f AS (SELECT doc_id AS commit_sha, CASE WHEN (i - 1) % 2 = 0 THEN '+' ELSE '-' END || ls[i] AS line FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)))"
_ADD, _REM = "(starts_with(line, '+') AND NOT starts_with(line, '+++'))", "(starts_with(line, '-') AND NOT starts_with(line, '---'))"


def _hit(signal: str) -> str:
    side = {"added": _ADD, "both": f"({_ADD} OR {_REM})", "removed": _REM}[signals.SIGNALS[signal][3]]
    pattern = signals.pattern(signal)[4:].replace("'", "''")
    return f"count(*) FILTER ({side} AND regexp_matches(line[2:], '{pattern}', 'i')) AS {signal}"


def _logs() -> str:
    has = f"regexp_matches(line[2:], '{signals.LOG_SIGNAL[3]}', 'i')"
    return f"greatest(count(*) FILTER ({_REM} AND {has}) - count(*) FILTER ({_ADD} AND {has}), 0) AS net_log_decrease"


SQL = {k: _CTE + v for k, v in {
    "session_rollup": "SELECT s.session_id, coalesce(any_value(client), '?') AS client, count(turn_id) AS n_turns, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, CAST(coalesce(sum(tool_call_count), 0) AS BIGINT) AS tool_calls FROM s LEFT JOIN t USING (session_id) GROUP BY s.session_id",
    "client_stats": "SELECT coalesce(client, '?') AS client, count(*) AS n, count(DISTINCT cwd) AS n_dirs, max(b - a) AS longest_ms FROM s GROUP BY ALL",
    "first_turn": "SELECT session_id, turn_id, ms FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ms, turn_id) AS k FROM t WHERE trim(user_prompt) <> '') WHERE k = 1",
    "step_token_delta": "SELECT turn_id, session_id, CAST(coalesce(cache_read_tokens, 0) - coalesce(lag(coalesce(cache_read_tokens, 0)) OVER w, 0) + coalesce(cache_creation_tokens, 0) - coalesce(lag(coalesce(cache_creation_tokens, 0)) OVER w, 0) + coalesce(output_tokens, 0) AS BIGINT) AS step_tokens FROM t WINDOW w AS (PARTITION BY session_id ORDER BY ms, turn_id)",
    "agent_loops": "SELECT session_id, CAST(loop AS BIGINT) AS loop, count(*) AS n_turns, CAST(sum(tool_call_count) AS BIGINT) AS n_tools FROM (SELECT *, sum(CASE WHEN tools AND NOT coalesce(prev, false) THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ms, turn_id ROWS UNBOUNDED PRECEDING) AS loop FROM (SELECT *, coalesce(tool_call_count, 0) > 0 AS tools, lag(coalesce(tool_call_count, 0) > 0) OVER (PARTITION BY session_id ORDER BY ms, turn_id) AS prev FROM t)) WHERE tools GROUP BY session_id, loop",
    "first_event_split": "SELECT session_id, count(*) FILTER (ms < f) AS n_before, count(*) FILTER (ms > f) AS n_after, count(*) FILTER (f IS NULL) AS n_without FROM (SELECT *, min(CASE WHEN tool_call_count > 3 THEN ms END) OVER (PARTITION BY session_id) AS f FROM t) GROUP BY session_id",
    "gap_sessions": "SELECT user_id, CAST(visit AS BIGINT) AS visit, count(*) AS n, round(sum(value), 2) AS value FROM (SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS visit FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id, visit",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL",
    "rolling_24h": "SELECT event_id, user_id, n_24h FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS n_24h FROM events) WHERE event_type = 'error'",
    "nearest_event_match": "SELECT event_id, click_id, gap_ms FROM (SELECT b.event_id, c.event_id AS click_id, abs(epoch_us(b.ts) // 1000 - epoch_us(c.ts) // 1000) AS gap_ms, row_number() OVER (PARTITION BY b.event_id ORDER BY abs(epoch_us(b.ts) // 1000 - epoch_us(c.ts) // 1000), epoch_us(c.ts)) AS k FROM events b JOIN events c ON b.user_id = c.user_id AND abs(epoch_us(b.ts) // 1000 - epoch_us(c.ts) // 1000) <= 7200000 WHERE b.event_type = 'purchase' AND c.event_type = 'click') WHERE k = 1",
    "json_predicate_sum": "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS sum_k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) > 50 GROUP BY ALL",
    "tool_error_rates": "SELECT source, count(*) AS n, count(error) AS n_errors, round(count(error) * 100 / greatest(count(*), 1), 1) AS error_pct FROM c GROUP BY ALL",
    "tokens_by_model": "SELECT model, count(*) AS n, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, CAST(coalesce(sum(cache_read_tokens), 0) AS BIGINT) AS cache_read_tokens, CAST(round(sum(CAST(cost_usd AS DECIMAL(18,8))), 4) AS DOUBLE) AS cost_usd FROM c GROUP BY model",
    "cube_calls": "SELECT model, failed, count(*) AS n FROM (SELECT model, error IS NOT NULL AS failed FROM c) GROUP BY CUBE (model, failed)",
    "attempts": "SELECT coalesce(TRY_CAST(json_extract_string(meta, '$.attempt') AS INT), 0) AS attempt, count(*) AS n, count(*) FILTER (json_extract_string(meta, '$.stop_reason') = 'max_tokens') AS n_cut FROM c GROUP BY ALL",
    "later_turns_ageing": "SELECT turn_id, staleness FROM (SELECT *, round(least(1.0, (count(*) OVER (PARTITION BY session_id ORDER BY ms DESC, turn_id DESC ROWS UNBOUNDED PRECEDING) - 1) * 0.2), 1) AS staleness FROM t) WHERE trim(insights_raw) <> ''",
    "question_classes": "SELECT CASE WHEN trim(q) = '' THEN 'blank' WHEN regexp_matches(q, 'who calls|callers? of|depend on|depends on') THEN 'graph' WHEN regexp_matches(q, 'tests? that|cover') THEN 'tests' WHEN regexp_matches(q, 'safe to remove|changed') THEN 'impact' ELSE 'other' END AS kind, count(*) AS n FROM (SELECT lower(coalesce(user_prompt, '')) AS q FROM t) GROUP BY ALL",
    "scan_progress": "SELECT id, len(f) AS n_steps, CAST(f[-1] AS BIGINT) AS last_parsed FROM (SELECT DISTINCT id, regexp_extract_all(logs, 'Parsed (\\d+) files', 1) AS f FROM scan_log WHERE logs IS NOT NULL) WHERE len(f) > 0",
    "scan_status": "SELECT scan_type, coalesce(status, '?') AS status, count(*) AS n, count(*) FILTER (exit_code <> 0) AS n_failed FROM (SELECT DISTINCT id, scan_type, status, exit_code FROM scan_log) GROUP BY ALL",
    "changed_lines": "SELECT 1",
    "mentioned_classes": "SELECT name, count(*) AS n_docs FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\\b', 1)) AS name FROM documents WHERE text IS NOT NULL) WHERE name NOT IN (SELECT display_name FROM symbols WHERE kind = 'class') GROUP BY name",
    "body_emptiness": "SELECT source, count(*) AS n, count(*) FILTER (length(array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT starts_with(x, '#') AND trim(x) <> ''), chr(10))) < 80) AS n_empty FROM documents GROUP BY ALL",
    "source_languages": "SELECT CASE WHEN regexp_matches(l, '^en') THEN 'en' WHEN regexp_matches(l, '^de') THEN 'de' WHEN regexp_matches(l, '^fr') THEN 'fr' WHEN regexp_matches(l, '^(es|spa)') THEN 'es' ELSE 'und' END AS code, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM (SELECT lower(trim(coalesce(lang, 'und'))) AS l, n_chars FROM documents) GROUP BY ALL",
    "reference_targets": "SELECT target, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(list_concat(regexp_extract_all(text, '\\]\\(([^)\\s#][^)\\s]*)\\)', 1), regexp_extract_all(text, '(?:href|src|action)=\"([^\"#][^\"]*)\"', 1), regexp_extract_all(text, '\\b([a-z]+(?:\\.[a-z]+){2,}(?:\\.[A-Z]\\w*)?)', 1))) AS target FROM documents WHERE text IS NOT NULL) GROUP BY target",
}.items()}
SQL["insight_scopes"] = _CTE + _INS + " SELECT json_extract_string(x, '$.scope') AS scope, count(*) AS n, count(DISTINCT json_extract_string(x, '$.applies_to')) AS n_targets, round(max(CAST(json_extract_string(x, '$.confidence') AS DOUBLE)), 2) AS best FROM x GROUP BY ALL"
SQL["insight_gate"] = _CTE + _INS + " SELECT session_id, k, json_extract_string(x, '$.applies_to') AS applies_to FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY CAST(json_extract_string(x, '$.confidence') AS DOUBLE) DESC, turn_id, at_) AS k FROM x WHERE CAST(json_extract_string(x, '$.confidence') AS DOUBLE) >= 0.5) WHERE k <= 3"
SQL["changed_lines"] = _CTE + _DIFF + f" SELECT commit_sha, count(*) FILTER ({_ADD}) AS n_added, count(*) FILTER ({_REM}) AS n_removed FROM f GROUP BY commit_sha"
SQL["signal_counts"] = _CTE + _DIFF + " SELECT commit_sha, " + ", ".join(map(_hit, ("crypto_function_changed", "retry_pattern_changed", "db_query_changed", "async_model_changed"))) + f", {_logs()} FROM f GROUP BY commit_sha"
SQL["log_classes"] = _CTE + ", g AS (SELECT id, unnest(regexp_split_to_array(logs, '\\r\\n|\\n|\\r')) AS line FROM (SELECT DISTINCT id, logs FROM scan_log WHERE logs IS NOT NULL)), h AS (SELECT id, count(*) AS n, count(*) FILTER (regexp_matches(line, '\\b(error|fatal|critical)\\b', 'i')) AS n_errors, count(*) FILTER (regexp_matches(line, '\\bwarn(ing)?\\b', 'i')) AS n_warnings, count(*) FILTER (regexp_matches(line, '^\\s*at |^Traceback|Exception')) AS n_traces FROM g GROUP BY id) SELECT *, n_errors * 2 > n AS storm FROM h"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
SQL["keyword_top3"] = _CTE + f""", w AS (SELECT turn_id, i AS at_, ws[i] AS word FROM (SELECT turn_id, ws, unnest(generate_series(1, len(ws))) AS i FROM (SELECT turn_id, regexp_extract_all(user_prompt, '([A-Za-z_][A-Za-z0-9_]*)', 1) AS ws FROM t WHERE user_prompt IS NOT NULL)) WHERE length(ws[i]) >= 3 AND lower(ws[i]) NOT IN ({_STOP})),
    v AS (SELECT *, CASE WHEN regexp_matches(word[1], '[A-Z]') THEN 2 ELSE 0 END + CASE WHEN contains(word, '_') THEN 2 ELSE 0 END + CASE WHEN length(word) >= 7 THEN 2 WHEN length(word) >= 5 THEN 1 ELSE 0 END AS score FROM w),
    o AS (SELECT *, row_number() OVER (PARTITION BY turn_id, lower(word) ORDER BY score DESC, at_) AS j FROM v), k AS (SELECT turn_id, row_number() OVER (PARTITION BY turn_id ORDER BY score DESC, at_) AS k, word, score FROM o WHERE j = 1)
    SELECT * FROM k WHERE k <= 3 UNION ALL SELECT turn_id, 1, CASE WHEN trim(user_prompt) = '' THEN '<query>' ELSE regexp_split_to_array(trim(user_prompt), '\\s+')[1][1:20] END, 0 FROM t WHERE user_prompt IS NOT NULL AND turn_id NOT IN (SELECT turn_id FROM k)"""


def _all_hits() -> str:
    """Every signal's hits in SQL, from the same tables."""
    file = "regexp_extract(line, '^diff --git a/.+ b/(.+)$', 1)"
    side = {"added": _ADD, "removed": _REM}
    quoted = lambda p: p.replace("'", "''")
    out = [_hit(s) for s in signals.SIGNALS]
    out += [f"count(*) FILTER ({file} <> '' AND regexp_matches({file}, '{quoted(p)}', 'i')) AS {s}" for s, (_, _, _, p) in signals.FILE_SIGNALS.items()]
    manifests = f"count(*) FILTER ({file} <> '' AND regexp_matches({file}, '{quoted(signals.MANIFESTS)}', 'i'))"
    out += [f"CASE WHEN {manifests} > 0 THEN count(*) FILTER ({side[v[3]]} AND regexp_matches(line[2:], '{quoted(v[4])}', 'i')) ELSE 0 END AS {s}" for s, v in signals.MANIFEST_SIGNALS.items()]
    package = "regexp_extract(line[2:], '^\\s*(?:import|from)\\s+([a-zA-Z_][a-zA-Z0-9_]*)', 1)"
    known = ", ".join(f"'{x}'" for x in signals.STDLIB)
    library = f"count(DISTINCT CASE WHEN {_ADD} AND {package} <> '' AND {package} NOT IN ({known}) THEN {package} END) + count(*) FILTER ({_ADD} AND regexp_matches(trim(line[2:]), '^[a-zA-Z][\\w\\-]+[>=<!~]')) AS new_third_party_lib"
    return ", ".join([*out, _logs(), library])


_GRAPH_SQL = {
    "endpoint_exposed": "least(1.0, endpoints * CAST(0.2 AS DOUBLE))", "policy_violation": "CAST(0 AS DOUBLE)", "high_fan_in": "CASE WHEN callers >= 5 THEN least(1.0, (callers - 5) / CAST(20 AS DOUBLE) + CAST(0.3 AS DOUBLE)) ELSE 0 END",
    "high_transitive_blast": "CASE WHEN transitive >= 10 THEN least(1.0, (transitive - 10) / CAST(40 AS DOUBLE) + CAST(0.25 AS DOUBLE)) ELSE 0 END",
}


def _vectors() -> str:
    per = signals._per_hit()
    out = []
    for vector in signals.VECTOR_WEIGHTS:
        own = [(f"least(1.0, {s} * CAST({p} AS DOUBLE))", w) for s, (v, w, p) in per.items() if v == vector] + [(_GRAPH_SQL[s], w) for s, (v, w) in signals.GRAPH_SIGNALS.items() if v == vector]
        out.append(f"round(least(1.0, ({' + '.join(f'{x} * CAST({w} AS DOUBLE)' for x, w in own)}) / CAST({sum(w for _, w in own)} AS DOUBLE)), 4) AS {vector}")
    return ", ".join(out)


_AROUND = """, nm AS (SELECT DISTINCT doc_id AS commit_sha, unnest(regexp_extract_all(text, '\\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\\b', 1)) AS name FROM documents WHERE text IS NOT NULL), kc AS (SELECT DISTINCT display_name AS name, file_path FROM symbols WHERE kind = 'class'),
us AS (SELECT DISTINCT target, name AS who FROM (SELECT DISTINCT file_path, unnest(regexp_extract_all(content, '(?:import [\\w.]*\\.|import \\{ |from \\w+ import )([A-Z]\\w*)', 1)) AS target FROM source_files WHERE content IS NOT NULL) JOIN kc USING (file_path) WHERE name <> target),
g1 AS (SELECT DISTINCT commit_sha, name FROM nm WHERE name IN (SELECT name FROM kc)), g2 AS (SELECT DISTINCT commit_sha, who AS name FROM g1 JOIN us ON us.target = g1.name), g3 AS (SELECT DISTINCT commit_sha, who AS name FROM g2 JOIN us ON us.target = g2.name),
ar AS (SELECT commit_sha, count(*) FILTER (kind = 1) AS direct, count(*) FILTER (kind = 2) AS callers, count(*) FILTER (kind = 3) AS transitive, count(*) FILTER (kind = 1 AND regexp_matches(name, '(Controller|Client)$')) AS endpoints FROM (SELECT *, 1 AS kind FROM g1 UNION ALL SELECT *, 2 FROM g2 UNION ALL SELECT *, 3 FROM g3) GROUP BY commit_sha)"""
_SCORED = _CTE + _DIFF + _AROUND + f", h0 AS (SELECT commit_sha, {_all_hits()} FROM f GROUP BY commit_sha), h AS (SELECT h0.*, coalesce(direct, 0) AS direct, coalesce(callers, 0) AS callers, coalesce(transitive, 0) AS transitive, coalesce(endpoints, 0) AS endpoints FROM h0 LEFT JOIN ar USING (commit_sha)), v AS (SELECT commit_sha, {_vectors()} FROM h)"
SQL["vector_scores"] = _SCORED + " SELECT * FROM v"
SQL["commit_risk"] = _SCORED + f" SELECT commit_sha, round(least(1.0, round(least(1.0, ({' + '.join(f'{v} * {w}' for v, w in signals.VECTOR_WEIGHTS.items())}) / {sum(signals.VECTOR_WEIGHTS.values())}), 4) * CAST(0.7 AS DOUBLE) + least(1.0, direct * CAST(0.04 AS DOUBLE) + callers * CAST(0.02 AS DOUBLE) + transitive * CAST(0.01 AS DOUBLE) + endpoints * CAST(0.10 AS DOUBLE)) * CAST(0.3 AS DOUBLE)), 4) AS risk FROM v JOIN h USING (commit_sha)"
