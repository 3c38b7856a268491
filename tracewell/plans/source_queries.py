"""Queries over sources and caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.plans.registry import query, read
from tracewell.plans.text_queries import by_case, case_sql
from tracewell.sources import documents, sinks
from tracewell.streaming import events as streams


@query("maven_tree", "SELECT DISTINCT 'g:c' || o_custkey || ':1' AS parent, 'g:o' || o_orderkey || ':1' AS child FROM orders UNION SELECT DISTINCT 'g:o' || o_orderkey || ':1', 'g:l' || l_partkey || ':1' FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def maven_tree(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    line = lambda prefix, letter, c: F.concat(F.lit(prefix + "g:" + letter), c, F.lit(":1"))
    top = o.select(F.col("o_custkey").alias("tree"), F.lit(0).cast("long").alias("n"), line("", "c", "o_custkey").alias("value")).distinct()
    mid = o.select("o_custkey", (F.col("o_orderkey") * 1000 + 1).alias("n"), line("[INFO] +- ", "o", "o_orderkey"))
    low = o.join(read(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", (F.col("o_orderkey") * 1000 + 2 + F.col("l_linenumber")).alias("n"), line("|  \\- ", "l", "l_partkey"))
    return documents.maven_tree(top.union(mid).union(low))


@query("go_modules", "SELECT DISTINCT 'm' || n_regionkey || '@v1' AS parent, 'n' || n_nationkey || '@v' || n_nationkey % 3 AS child, 'n' || n_nationkey AS module, 'v' || n_nationkey % 3 AS version FROM nation")
def go_modules(spark, sf_dir):
    v = F.concat(F.lit("m"), "n_regionkey", F.lit("@v1 n"), "n_nationkey", F.lit("@v"), F.col("n_nationkey") % 3)
    return documents.go_modules(read(spark, sf_dir, "nation").select(v.alias("value")))


@query("pip_show", "SELECT 'lib-' || s_suppkey AS name, '1.' || s_nationkey AS version, 'a-b,c' AS requires FROM supplier")
def pip_show(spark, sf_dir):
    block = F.concat(F.lit("Name: Lib_"), "s_suppkey", F.lit("\nVersion: 1."), "s_nationkey", F.lit("\nLocation: /x\nRequires: A.b, c\n"))
    return documents.pip_show(read(spark, sf_dir, "supplier").select(block.alias("value"))).select("name", "version", F.array_join("requires", ",").alias("requires"))


@query("gradle_dependencies", "SELECT l_returnflag AS \"group\", l_linestatus AS name, min(l_partkey) AS path FROM lineitem GROUP BY ALL")
def gradle_dependencies(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("group"), F.col("l_linestatus").alias("name"), F.lit("1").alias("version"), F.col("l_partkey").alias("path"), F.lit(None).cast("string").alias("source"))
    return documents.gradle_dependencies(rows).select("group", "name", "path")


_PACKAGE, _TOOLS = '[project]\nname = "x"', "[tool.black]\nline-length = 9"
#: The manifests of a root, and its ecosystem.
ROOTS = (
    ({"go.mod": "", "Cargo.toml": "", "pyproject.toml": _PACKAGE}, "go"), ({"build.gradle.kts": "", "pyproject.toml": _PACKAGE}, "java"), ({"settings.gradle": "", "package.json": ""}, "java"), ({"Cargo.toml": "", "pyproject.toml": _PACKAGE}, "python"),
    ({"Cargo.toml": "", "pyproject.toml": _TOOLS}, "rust"), ({"Cargo.toml": "", "pyproject.toml": '[build-system]\nrequires = ["Maturin>=1.0 ; x"]'}, "python"), ({"Cargo.toml": "", "pyproject.toml": '[build-system]\nbuild-backend = "poetry-core.masonry"'}, "python"),
    ({"Cargo.toml": "", "pyproject.toml": "[tool.maturin]\nx = 1"}, "python"), ({"Cargo.toml": "", "pyproject.toml": "[broken"}, "rust"), ({"pyproject.toml": _TOOLS}, "python"), ({"Pipfile": ""}, "python"), ({"requirements.txt": "", "package.json": ""}, "python"),
    ({"package.json": ""}, "node"), ({"README.md": ""}, None),
)


@query("ecosystems", f"SELECT * FROM (SELECT c_custkey AS root, {case_sql('c_custkey', [e for _, e in ROOTS])} AS ecosystem FROM customer) WHERE ecosystem IS NOT NULL")
def ecosystems(spark, sf_dir):
    names = sorted({n for files, _ in ROOTS for n in files})
    contents = by_case(F.col("c_custkey"), [[files.get(n) for n in names] for files, _ in ROOTS])
    each = F.array(*[F.struct(F.lit(f"x/{n}").alias("path"), c.cast("string").alias("content")) for n, c in zip(names, contents, strict=True)])
    files = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("root"), F.inline(each)).where("content is not null")
    return documents.detect_ecosystem(files, content="content")


@query("contract_merge", "SELECT l_partkey AS method, l_linenumber AS arity, min(l_returnflag) AS return_type, count(DISTINCT l_returnflag) > 1 AS conflict FROM lineitem GROUP BY ALL")
def contract_merge(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("library"), F.col("l_partkey").alias("method"), F.col("l_linenumber").alias("arity"), F.lit(None).cast("string").alias("condition"), F.col("l_returnflag").alias("return_type"), F.lit("factory").alias("role"))
    return documents.merge_contracts(rows).select("method", "arity", "return_type", "conflict")


@query("contract_checks", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber - 3 < 0 OR l_returnflag = 'R'")
def contract_checks(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("method", F.lit("m")).withColumn("arity", F.col("l_linenumber") - 3).withColumn("confidence", F.when(F.col("l_returnflag") == "R", "sure").otherwise("high"))
    return documents.bad_contracts(rows).select("l_orderkey", "l_linenumber", "l_partkey")


@query("cache_states", "SELECT event_id, CASE WHEN a <= CASE WHEN event_type = 'view' THEN 86400 ELSE 604800 END THEN 'fresh' WHEN a <= 2592000 THEN 'stale' ELSE 'expired' END AS state FROM (SELECT event_id, event_type, floor(epoch(TIMESTAMP '2024-01-31')) - floor(epoch(ts)) AS a FROM events)")
def cache_states(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", "latest").otherwise("v1").alias("version"), F.col("ts").cast("timestamp").alias("downloaded_at"), F.lit("2024-01-31 00:00:00").cast("timestamp").alias("now"))
    return documents.cache_state(rows).select("event_id", "state")


@query("cache_misses", "SELECT o_orderkey AS cache_key, o_custkey % 2 AS schema_version FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey % 2 = o_custkey % 2)")
def cache_misses(spark, sf_dir):
    wanted = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cache_key"), (F.col("o_custkey") % 2).alias("schema_version"))
    cache = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cache_key"), (F.col("l_suppkey") % 2).alias("schema_version")).distinct()
    return documents.cached_work(wanted, cache)[1]


@query("component_export", "SELECT DISTINCT p_brand AS name, 'crypto/algorithm/' || substr(sha256('algorithm|' || p_brand), 1, 16) AS ref FROM part")
def component_export(spark, sf_dir):
    rows = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.lit("algorithm").alias("asset_type"), F.lit("hash").alias("primitive"), F.lit(None).cast("string").alias("mode"), F.max("p_size").alias("key_bits"), F.lit(None).cast("string").alias("oid"), F.array(F.lit("digest")).alias("functions"), F.lit(None).cast("string").alias("material"), F.lit(None).cast("string").alias("protocol_version"), F.lit(None).cast("string").alias("subject"), F.collect_set("p_partkey").alias("occurrences"))
    return sinks.components(rows).select("name", F.col("bom-ref").alias("ref"))


@query("report_summary", "SELECT count(DISTINCT l_orderkey) AS n_files, count(*) AS n_findings FROM lineitem")
def report_summary(spark, sf_dir):
    return sinks.summary(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_path")))


@query("event_sessions", """WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n_events FROM s GROUP BY user_id, n""")
def event_sessions(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return streams.sessions(rows, gap="6 hours").select("user_id", F.unix_seconds("start").alias("start"), "n_events")


@query("phase_durations", "SELECT event_type AS phase, CASE WHEN user_id % 2 = 0 THEN 'completed' ELSE 'failed' END AS status, count(*) AS n, sum(CAST(user_id AS BIGINT))::BIGINT AS duration_ms FROM events GROUP BY ALL")
def phase_durations(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("phase"), F.when(F.col("user_id") % 2 == 0, "completed").otherwise("failed").alias("status"), F.col("user_id").alias("duration_ms"))
    return streams.phase_durations(rows)
