"""Queries over text: detection, identities, names, predicates, dead code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import assets, conditions, ids, text
from tracewell.operators import detect, report
from tracewell.plans.registry import query, read
from tracewell.session import spread

RULES = (
    detect.Rule("rules/pii/email", r"[a-z0-9._]+@[a-z0-9.-]+\.[a-z]+", "warning"),
    detect.Rule("rules/pii/number", r"[0-9]{15,16}", "warning"),
    detect.Rule("rules/secret/token", r'token = "[0-9a-f]+"', "error"),
    detect.Rule("rules/layout/table", r"[a-z]+ \| [a-z]+", "info"),
    detect.Rule("rules/layout/shout", r"[A-Z]{3,}!!", "info"),
    detect.Rule("rules/pii/phone", r"\+1 \([0-9]{3}\) [0-9-]+", "warning"),
)
_HITS = "\n  UNION ALL ".join(f"SELECT path, lang, source, line, content, regexp_extract_all(content, '{r.pattern}') AS m, string_split_regex(content, '{r.pattern}') AS s, '{r.id}' AS rule_id, '{r.severity.upper()}' AS severity FROM lines WHERE regexp_matches(content, '{r.pattern}')" for r in RULES)
#: DuckDB: ``hits`` has what ``hits`` below returns.  A match begins behind the texts and matches before it.
HITS_SQL = f"""files AS (SELECT source || '/' || doc_id || '.txt' AS path, lang, source, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
lines AS (SELECT path, lang, source, unnest(generate_series(1, len(l))) AS line, unnest(l) AS content FROM files),
raw AS ({_HITS}),
each AS (SELECT *, unnest(generate_series(1, len(m))) AS i FROM raw),
hits AS (SELECT path, lang, source, line, len(array_to_string(s[1:i], '')) + len(array_to_string(m[1:i - 1], '')) + 1 AS col, m[i] AS match, rule_id, severity FROM each)"""


def by_case(number, cases):
    """The case that a row's number falls on, as a column of each of its values; nothing is left out, cases repeat."""
    at = (F.pmod(number, F.lit(len(cases))) + 1).cast("int")
    return [F.element_at(F.array(*[F.lit(x) for x in column]), at) for column in zip(*cases, strict=True)]


def case_sql(number: str, values) -> str:
    """DuckDB: the value of the case that a row's number falls on."""
    said = ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{said}])[{number} % {len(values)} + 1]"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), "text", "lang", "source")
    return spread(rows)


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect_lines(files(spark, sf_dir), RULES, keep=("lang", "source"))


@query("detect_lines", f"WITH {HITS_SQL} SELECT path, line, col, match, rule_id, severity FROM hits")
def detect_lines(spark, sf_dir):
    return hits(spark, sf_dir).select("path", "line", "col", "match", "rule_id", "severity")


@query("detect_by_language", f"WITH {HITS_SQL} SELECT lang, source, rule_id, count(*) AS n_findings, count(DISTINCT path) AS n_files FROM hits GROUP BY ALL")
def detect_by_language(spark, sf_dir):
    return hits(spark, sf_dir).groupBy("lang", "source", "rule_id").agg(F.count("*").alias("n_findings"), F.count_distinct("path").alias("n_files"))


@query("rule_language_filter", f"WITH {HITS_SQL} SELECT lang, count(*) AS n FROM hits WHERE rule_id LIKE 'rules/pii/%' GROUP BY lang")
def rule_language_filter(spark, sf_dir):
    rules = [detect.Rule(r.id, r.pattern, r.severity, ("text",) if "pii" in r.id else ("java",)) for r in RULES]
    return detect.detect_lines(files(spark, sf_dir), detect.rules_for(rules, ["text"]), keep=("lang",)).groupBy("lang").agg(F.count("*").alias("n"))


_ID = "substr(sha256(concat_ws(':', path, line, replace(rule_id, 'rules/', ''))), 1, 8)"


@query("finding_ids", f"WITH {HITS_SQL} SELECT path AS file_path, line AS start_line, col AS start_col, col + length(match) AS end_col, trim(match) AS match, replace(rule_id, 'rules/', '') AS rule_id, severity, 'pending' AS status, {_ID} AS finding_id FROM hits")
def finding_ids(spark, sf_dir):
    out = detect.to_assets(hits(spark, sf_dir), rule_prefixes=("rules/", "ru"))
    return out.select("file_path", "start_line", "start_col", "end_col", "match", "rule_id", "severity", "status", "finding_id")


@query("dependency_paths", f"WITH {HITS_SQL} SELECT CASE WHEN source IN ('src1', 'src2') THEN path ELSE source || '@1.0/' || path END AS file_path, count(*) AS n FROM hits GROUP BY 1")
def dependency_paths(spark, sf_dir):
    module = F.when(F.col("source").isin("src1", "src2"), "").otherwise(F.col("source"))
    return hits(spark, sf_dir).groupBy(ids.dependency_path(module, F.lit("1.0"), "path").alias("file_path")).agg(F.count("*").alias("n"))


@query("supporting_ids", "SELECT DISTINCT p_partkey, substr(sha256(concat_ws(':', p_brand, p_size, p_name)), 1, 8) AS supporting_id FROM part")
def supporting_ids(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", ids.supporting_id("p_brand", "p_size", "p_name").alias("supporting_id")).distinct()


@query("ambiguity_ids", "SELECT p_partkey, 'amb-' || substr(sha256(p_brand || '|' || coalesce(p_type, '') || '|' || p_size), 1, 16) AS ambiguity_id FROM part")
def ambiguity_ids(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", ids.ambiguity_id("p_brand", "p_type", "p_size").alias("ambiguity_id"))


@query(
    "occurrence_numbers",
    f"""WITH {HITS_SQL}, h AS (SELECT *, substr(sha256(concat_ws(chr(10), match, source, rule_id, 'call', '0/1')), 1, 16) AS hash FROM hits),
n AS (SELECT *, dense_rank() OVER (PARTITION BY hash ORDER BY path, line, col) AS ordinal FROM h)
SELECT path, line, col, rule_id, 'v1:' || hash || CASE WHEN ordinal > 1 THEN '-' || ordinal ELSE '' END AS occurrence_key FROM n""",
)
def occurrence_numbers(spark, sf_dir):
    rows = hits(spark, sf_dir).withColumn("hash", ids.occurrence_hash("match", "source", "rule_id", F.lit("call"), F.lit("0/1")))
    rows = report.number_occurrences(rows, "hash", ("path", "line", "col"))
    return rows.select("path", "line", "col", "rule_id", ids.occurrence_key("hash", "ordinal").alias("occurrence_key"))


@query("matches_by_file", f"WITH {HITS_SQL} SELECT path, count(*) AS n_matches, string_agg(line || ':' || col || ':' || rule_id, ',' ORDER BY line, col, rule_id) AS matches FROM hits GROUP BY path")
def matches_by_file(spark, sf_dir):
    grouped = report.group_by_file(hits(spark, sf_dir).select("path", "line", "col", "rule_id"), order=("line", "col", "rule_id"))
    return grouped.select("path", "n_matches", F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["line"], m["col"], m["rule_id"])), ",").alias("matches"))


@query("relative_paths", "SELECT page_id, CASE WHEN url LIKE 'https://%' THEN substr(url, 9) ELSE url END AS path FROM pages")
def relative_paths(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.relative_path("url", F.lit("https://")).alias("path"))


@query("metavariables", "SELECT p_partkey, 'brand ' || p_brand || ' [' || p_type || '] [' || p_size || '] [' || p_size % 7 || '] [' || p_name || '] [$T] [] [' || p_type || p_size || '$] 5$' AS message FROM part")
def metavariables(spark, sf_dir):
    none = F.lit(None).cast("string")
    value = lambda c, p=none: F.struct(c.cast("string").alias("content"), p.alias("propagated"))
    known = {
        "T": value(F.concat(F.lit('"'), "p_type", F.lit('"'))), "$TS": value(F.col("p_name"), F.col("p_size").cast("string")), "BRAND": value(F.col("p_brand")),
        "1": value(F.col("p_size") % 7), "$name": value(F.col("p_name")), "A": value(F.lit("$T")), "GONE": value(F.lit("matched"), F.lit("")),
    }
    found = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), v)])
    template = F.lit("brand $BRAND [$T] [$TS] [$1] [$name] [$A] [$MISSING$GONE$2] [$T$TS$] 5$")
    return spread(read(spark, sf_dir, "part")).select("p_partkey", text.substitute(template, text.metavariable_values(found)).alias("message"))


NAMES = (
    (" triple_des ", "DES-EDE"), ("3des", "DES-EDE"), ("3_DES", "DES-EDE"), ("TripleDES", "DES-EDE"), ("sha2", "SHA"), ("SHA-3", "SHA"), ("sha 256", "SHA-256"), ("aes__128 -gcm", "AES-128-GCM"),
    ("desede", "DESEDE"), ("Rijndael", "RIJNDAEL"), ("", ""), (None, None),
)


@query("name_normalise", f"SELECT p_partkey, regexp_replace(upper(trim(p_name)), '[_ -]+', '-', 'g') AS name, {case_sql('p_partkey', [n for _, n in NAMES])} AS known FROM part")
def name_normalise(spark, sf_dir):
    given, _ = by_case(F.col("p_partkey"), NAMES)
    return read(spark, sf_dir, "part").select("p_partkey", assets.normal_name("p_name").alias("name"), assets.normal_name(given).alias("known"))


@query("algorithm_names", "SELECT p_partkey, p_brand || CASE WHEN p_size % 3 = 0 THEN '' ELSE '-' || p_size END || CASE WHEN p_size % 2 = 0 THEN '-' || upper(p_type) ELSE '' END AS name FROM part")
def algorithm_names(spark, sf_dir):
    size = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_size").cast("string"))
    mode = F.when(F.col("p_size") % 2 == 0, F.col("p_type"))
    return read(spark, sf_dir, "part").select("p_partkey", assets.algorithm_name(F.lit(""), "p_brand", size, mode).alias("name"))


@query("operation_kind", "SELECT event_id, CASE WHEN contains(t, '(') AND contains(t, ')') THEN 'call' WHEN regexp_matches(t, '^[A-Za-z0-9_$.]+$') THEN 'type_usage' ELSE 'expression' END AS kind FROM (SELECT event_id, trim(CASE event_id % 3 WHEN 0 THEN event_type || '()' WHEN 1 THEN event_type ELSE props END) AS t FROM events)")
def operation_kind(spark, sf_dir):
    t = F.when(F.col("event_id") % 3 == 0, F.concat("event_type", F.lit("()"))).when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise(F.col("props"))
    return read(spark, sf_dir, "events").select("event_id", assets.operation_kind(t).alias("kind"))


#: given, name, built name, family, and the identifier.
OID_CASES = (
    ("9.9", "rsa", "", "", "9.9"), ("", "sha_256", "", "", "2.16.840.1.101.3.4.2.1"), ("", "", "AES-256-GCM", "AES", "2.16.840.1.101.3.4.1.46"), ("", "none", "", "aes", "2.16.840.1.101.3.4.1"),
    ("", "", "", "triple_des", "1.3.14.3.2.17"), ("", "ML-KEM-768", "", "", "2.16.840.1.101.3.4.4.2"), ("", "", "SLH-DSA-SHAKE-256f", "", "2.16.840.1.101.3.4.3.31"), ("", "hmac-sha512", "", "", "1.2.840.113549.2.11"),
    ("", "ed25519", "", "", "1.3.101.112"), ("", "x", "y", "z", None), ("", "", "", "SHA3", "2.16.840.1.101.3.4.2"), ("", "ecdsa-sha384", "", "", "1.2.840.10045.4.3.3"), ("", "", "", "HMAC", "1.2.840.113549.2"),
    ("", "des-cbc", "", "", "1.3.14.3.2.7"), ("", "sha1_with_rsa", "", "", "1.3.14.3.2.29"), ("", "PBKDF2", "", "", "1.2.840.113549.1.5.12"), ("", "aes-192-wrap-pad", "", "", "2.16.840.1.101.3.4.1.28"), ("", "sha-512/256", "", "sha2", "2.16.840.1.101.3.4.2"),
    ("", "ML-DSA-87", "", "", "2.16.840.1.101.3.4.3.19"), ("", "rsa-sha224", "", "", "1.2.840.113549.1.1.14"),
)


@query("oid_lookup", f"SELECT c_custkey, {case_sql('c_custkey', [c[-1] for c in OID_CASES])} AS oid FROM customer")
def oid_lookup(spark, sf_dir):
    given, name, built, family, _ = by_case(F.col("c_custkey"), OID_CASES)
    return read(spark, sf_dir, "customer").select("c_custkey", assets.object_identifier(given, name, built, family).alias("oid"))


FUNCTION_CASES = (
    ("generate", "generate"), ("Key Generation", "keygen"), ("KEYGEN", "keygen"), ("encrypt", "encrypt"), ("decrypt", "decrypt"), ("digest", "digest"), (" Hash ", "digest"), ("tag", "tag"), ("key-derivation", "keyderive"),
    ("derivekey", "keyderive"), ("key_derive", "keyderive"), ("derive", "keyderive"), ("sign", "sign"), ("Signature", "sign"), ("verify", "verify"), ("verification", "verify"), ("keyver", "verify"), ("encapsulate", "encapsulate"),
    ("decapsulate", "decapsulate"), ("other", "other"), ("unknown", "unknown"), ("random", "other"), ("handshake", "other"), ("Encryption", "other"), ("mac", "other"), ("  ", None), ("", None), (None, None),
)


@query("crypto_functions", f"SELECT event_id, {case_sql('event_id', [f for _, f in FUNCTION_CASES])} AS function, CASE WHEN event_type = 'view' THEN 'hash' ELSE NULL END AS primitive FROM events")
def crypto_functions(spark, sf_dir):
    raw, _ = by_case(F.col("event_id"), FUNCTION_CASES)
    return read(spark, sf_dir, "events").select("event_id", assets.crypto_function(raw).alias("function"), assets.primitive(F.when(F.col("event_type") == "view", "HASH").otherwise("nothing")).alias("primitive"))


#: derivation, argument, bits.
KEY_CASES = (
    ("argument_value", "256", 256), ("argument_value", " 128 ", 128), ("argument_value", "cfg.keyLen2", None), ("argument_value", "0", None), ("argument_value", "-8", None), ("argument_value", "KEY_256", None),
    ("argument_value", "99999999999", None), ("argument_bit_length", "new byte[16]", 128), ("argument_bit_length", "new  byte[ 32 ]", 256), ("argument_bit_length", "new byte[5000]", None), ("argument_bit_length", "new byte[n]", None),
    ("argument_bit_length", "new byte[0]", None), ("argument_bit_length", '"0123456789abcdef"', 128), ("argument_bit_length", '""', None), ("argument_bit_length", "secret", None), ("argument_bit_length", '"\u00e9"', 16),
    ("argument_curve_bits", '"secp224r1"', 224), ("argument_curve_bits", '" P-521 "', 521), ("argument_curve_bits", "secp256r1", None), ("argument_curve_bits", '"curve9"', None), ("argument_curve_bits", '"sect283k1"', 283),
    ("argument_curve_bits", '"brainpoolP384r1"', 384), ("argument_type", "AES", None), (None, "128", None), ("argument_value", None, None),
)


@query("key_length_derive", f"SELECT p_partkey, CAST({case_sql('p_partkey', [b for _, _, b in KEY_CASES])} AS INTEGER) AS bits, CAST(8 * length(p_name) AS INTEGER) AS name_bits, CAST(p_size AS INTEGER) AS size_bits FROM part")
def key_length_derive(spark, sf_dir):
    kind, value, _ = by_case(F.col("p_partkey"), KEY_CASES)
    name = F.concat(F.lit('"'), "p_name", F.lit('"'))
    return read(spark, sf_dir, "part").select(
        "p_partkey", assets.key_bits(kind, value).alias("bits"), assets.key_bits(F.lit("argument_bit_length"), name).alias("name_bits"), assets.key_bits(F.lit("argument_value"), F.col("p_size").cast("string")).alias("size_bits")
    )


@query("key_length_conflict", "SELECT l_orderkey, l_linenumber, l_suppkey, coalesce(r, d) AS bits, CASE WHEN r <> d AND d > 0 THEN d END AS declared_bits, coalesce(r <> d AND d > 0, false) AS conflict FROM (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_quantity AS INTEGER) END AS r, CAST(l_suppkey % 5 * 10 AS INTEGER) AS d FROM lineitem)")
def key_length_conflict(spark, sf_dir):
    resolved = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity").cast("int"))
    declared = (F.col("l_suppkey") % 5 * 10).cast("int")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", assets.key_length(resolved, declared).alias("k")).select("l_orderkey", "l_linenumber", "l_suppkey", "k.*")


@query("function_keys", "SELECT p_partkey, 'pkg' || p_size || '.(K' || p_partkey || ').run' || '#' || p_size % 4 AS key, 'pkg' || p_size AS package, 'K' || p_partkey AS owner, 'run' AS name, p_size % 4 AS arity FROM part")
def function_keys(spark, sf_dir):
    rows = read(spark, sf_dir, "part")
    rows = rows.withColumn("key", ids.function_key(F.concat(F.lit("pkg"), "p_size"), F.concat(F.lit("K"), "p_partkey"), F.lit("run"), F.col("p_size") % 4))
    return rows.select("p_partkey", "key", ids.parse_function_key("key").alias("f")).select("p_partkey", "key", "f.package", "f.owner", "f.name", "f.arity")


@query("signatures", "SELECT p_partkey, p_brand || '(' || p_type || ', ?): ?' AS canonical, p_brand || '(List,Number[])' AS erased FROM part")
def signatures(spark, sf_dir):
    bounds = F.create_map(F.lit("T"), F.lit("Number"))
    return read(spark, sf_dir, "part").select(
        "p_partkey",
        ids.canonical_signature("p_brand", F.array("p_type", F.lit(" ")), F.lit(None).cast("string")).alias("canonical"),
        ids.erased_signature("p_brand", F.array(F.lit("List<Map<String,T>>"), F.lit("T[]")), bounds).alias("erased"),
    )


@query("package_urls", "SELECT s_suppkey, url, kind, name, version FROM (SELECT s_suppkey, s_suppkey % 3 AS k, CASE s_suppkey % 3 WHEN 0 THEN 'pkg:maven/org.x/' || s_nationkey || '@1.' || s_suppkey WHEN 1 THEN 'pkg:pypi/my-lib-' || s_nationkey || '@1.' || s_suppkey ELSE 'pkg:golang/example.org/m/' || s_nationkey || '@1.' || s_suppkey END AS url, CASE s_suppkey % 3 WHEN 0 THEN 'maven' WHEN 1 THEN 'pypi' ELSE 'golang' END AS kind, CASE s_suppkey % 3 WHEN 1 THEN 'my-lib-' || s_nationkey ELSE '' || s_nationkey END AS name, '1.' || s_suppkey AS version FROM supplier)")
def package_urls(spark, sf_dir):
    k = F.col("s_suppkey") % 3
    eco = F.when(k == 0, "java").when(k == 1, "pip").otherwise("go")
    n = F.col("s_nationkey").cast("string")
    name = F.when(k == 0, F.concat(F.lit("org.x:"), n)).when(k == 1, F.concat(F.lit("My_Lib."), n)).otherwise(F.concat(F.lit("example.org/m/"), n))
    rows = read(spark, sf_dir, "supplier").withColumn("url", ids.package_url(eco, name, F.concat(F.lit("1."), "s_suppkey")))
    return rows.select("s_suppkey", "url", ids.url_identity("url").alias("i"), ids.url_version("url").alias("version")).select("s_suppkey", "url", F.col("i.type").alias("kind"), "i.name", "version")


@query("durations", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 60 * n WHEN 1 THEN 86400 * n WHEN 2 THEN 604800 * n ELSE NULL END AS seconds FROM (SELECT o_orderkey, o_custkey % 90 AS n FROM orders)")
def durations(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    unit = F.when(k == 0, "m").when(k == 1, "d").when(k == 2, "w").otherwise("y")
    return read(spark, sf_dir, "orders").select("o_orderkey", text.duration_seconds(F.concat((F.col("o_custkey") % 90).cast("string"), unit)).alias("seconds"))


@query("skip_paths", "SELECT page_id, url LIKE '%/en/%' AND NOT url LIKE '%/en/1%' AS skipped FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS url FROM pages)")
def skip_paths(spark, sf_dir):
    path = F.regexp_replace("url", "^https?://", "")
    return read(spark, sf_dir, "pages").select("page_id", text.skipped(path, ("**/en/**", "!**/en/1*")).alias("skipped"))


_COND = "CASE WHEN p_size % 5 = 0 THEN 'unknown' WHEN p_size > 10 AND p_brand = 'Brand#1' THEN 'matched' WHEN p_size > 10 AND p_brand <> 'Brand#1' THEN 'refuted' ELSE 'refuted' END"


@query(
    "condition_verdicts",
    """SELECT p_partkey, CASE WHEN NOT a THEN 'refuted' WHEN s = '' AND p_size % 5 = 0 THEN 'unknown' WHEN p_size > 10 THEN 'matched' ELSE 'refuted' END AS verdict
FROM (SELECT *, regexp_matches(p_brand, '[1-3]') AS a, CASE WHEN p_size % 5 = 0 THEN '' ELSE 'x' END AS s FROM part)""",
)
def condition_verdicts(spark, sf_dir):
    arguments = F.create_map(F.lit("0"), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_size").cast("string")), F.lit("brand"), F.col("p_brand"))
    parsed = conditions.conditions(F.lit("param[0] > 10, param[brand] =~ '[1-3]'"))
    return read(spark, sf_dir, "part").select("p_partkey", conditions.evaluate(parsed, arguments).alias("verdict"))


@query(
    "condition_chain_filter",
    """WITH c AS (SELECT l_orderkey AS f, l_linenumber AS n, l_suppkey AS s, CASE l_linenumber % 3 WHEN 0 THEN 'refuted' WHEN 1 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'matched' ELSE 'unknown' END ELSE 'unknown' END AS v FROM lineitem),
m AS (SELECT *, max(v = 'matched') OVER (PARTITION BY f) AS any_match FROM c)
SELECT f AS finding_id, n AS chain, s AS via, v AS verdict FROM m WHERE v = 'matched' OR (v = 'unknown' AND NOT any_match)""",
)
def condition_chain_filter(spark, sf_dir):
    n = F.col("l_linenumber") % 3
    v = F.when(n == 0, "refuted").when((n == 1) & (F.col("l_suppkey") % 2 == 0), "matched").otherwise("unknown")
    return conditions.keep_chains(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("finding_id"), F.col("l_linenumber").alias("chain"), F.col("l_suppkey").alias("via"), v.alias("verdict")))


@query("condition_captures", "SELECT p_partkey, regexp_extract(p_brand, '([A-Za-z]+)#?([0-9]*)', 1) AS word, regexp_extract(p_brand, '([A-Za-z]+)#?([0-9]*)', 2) AS number FROM part WHERE regexp_matches(p_brand, '([A-Za-z]+)#?([0-9]*)')")
def condition_captures(spark, sf_dir):
    found = read(spark, sf_dir, "part").select("p_partkey", conditions.captures(F.lit("(?P<word>[A-Za-z]+)#?([0-9]*)"), F.col("p_brand")).alias("m")).where("m is not null")
    return found.select("p_partkey", F.col("m")["word"].alias("word"), F.col("m")["2"].alias("number"))


@query("split_arguments", "SELECT p_partkey, 3 AS n, p_brand AS first, 'f(' || p_size || ', 2)' AS second FROM part")
def split_arguments(spark, sf_dir):
    parts = text.split_list(F.concat(F.col("p_brand"), F.lit(", f("), F.col("p_size"), F.lit(', 2), "a,b"')))
    return read(spark, sf_dir, "part").select("p_partkey", parts.alias("p")).select("p_partkey", F.size("p").alias("n"), F.col("p")[0].alias("first"), F.col("p")[1].alias("second"))


@query("strip_comments", "SELECT p_partkey, p_brand || '  \"// ' || p_type || '\" ' AS code FROM part")
def strip_comments(spark, sf_dir):
    code = F.concat("p_brand", F.lit(" /* c */ \"// "), "p_type", F.lit('" // tail'))
    return read(spark, sf_dir, "part").select("p_partkey", text.strip_comments(code).alias("code"))


@query("qualified_symbols", "SELECT doc_id, CASE WHEN lang = 'en' THEN dots >= 2 ELSE dots >= 1 END AS qualified FROM (SELECT doc_id, lang, length(s) - length(replace(s, '.', '')) AS dots FROM (SELECT doc_id, lang, 'a.' || source || CASE WHEN doc_id % 2 = 0 THEN '.c' ELSE '' END AS s FROM documents))")
def qualified_symbols(spark, sf_dir):
    s = F.concat(F.lit("a."), "source", F.when(F.col("doc_id") % 2 == 0, ".c").otherwise(""))
    return read(spark, sf_dir, "documents").select("doc_id", text.symbol_is_qualified(s, F.when(F.col("lang") == "en", "java").otherwise("go")).alias("qualified"))


@query("user_packages", "SELECT source, count(*) AS n FROM documents WHERE source = 'src1' OR source LIKE 'src1/%' GROUP BY source")
def user_packages(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(text.in_user_package("source", ("src1",), "/")).groupBy("source").agg(F.count("*").alias("n"))


@query("inference_triggers", "SELECT event_type, count(*) AS n FROM events WHERE event_type = 'view' OR event_type = 'click' GROUP BY event_type")
def inference_triggers(spark, sf_dir):
    declared = F.when(F.col("event_type") == "view", "Object").when(F.col("event_type") == "click", "Foo*").otherwise("String")
    return read(spark, sf_dir, "events").where(text.wants_inference(declared)).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "dead_region_filter",
    """WITH a AS (SELECT o_orderkey, o_custkey % 9 + 1 AS l FROM orders)
SELECT o_orderkey, l AS line FROM a WHERE NOT (l BETWEEN 2 AND 6)""",
)
def dead_region_filter(spark, sf_dir):
    code = "int a;\n#if 0\n#ifdef X\nb();\n#endif\n#else\nc();\n#endif\nd();"
    found = read(spark, sf_dir, "orders").select("o_orderkey", F.lit("f.c").alias("file_path"), (F.col("o_custkey") % 9 + 1).alias("start_line"), (F.col("o_custkey") % 9 + 1).alias("end_line"))
    regions = report.dead_regions(spark.createDataFrame([("f.c", code), ("g.c", "#if 0\nnever ends")], "path string, content string"))
    return report.drop_dead(found, regions).select("o_orderkey", F.col("start_line").alias("line"))


@query("language_counts", "SELECT CASE lang WHEN 'en' THEN 'Go' WHEN 'de' THEN 'Java' ELSE 'Python' END AS language, count(*) AS n_files FROM documents WHERE lang IN ('en', 'de', 'fr') GROUP BY 1")
def language_counts(spark, sf_dir):
    ext = F.concat(F.lit("a/f."), F.col("lang"))
    return detect.detect_languages(read(spark, sf_dir, "documents").select(ext.alias("path")), {".en": "Go", ".de": "Java", ".fr": "Python"})


@query("display_symbols", "SELECT p_partkey, 'a.' || p_size || '.K.K' AS symbol FROM part")
def display_symbols(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", ids.display_symbol(F.concat(F.lit("a."), "p_size", F.lit(".K.<init>"))).alias("symbol"))
