"""Reading what other tools wrote: match documents, reports, fragments, dependency lists, contracts, caches."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_POINT = "struct<line:int,col:int,offset:int>"
MATCH_SCHEMA = (
    f"results array<struct<check_id:string,path:string,start:{_POINT},end:{_POINT},extra:struct<message:string,severity:string,lines:string,"
    "metadata:struct<crypto:map<string,string>,purl:string>,metavars:map<string,struct<abstract_content:string,propagated_value:struct<svalue_abstract_content:string>>>>>>,"
    "errors array<struct<code:int,level:string,message:string,path:string>>"
)


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """Results of match documents, one row a match, metavariables as name → (content, propagated)."""
    rows = spark.read.schema(MATCH_SCHEMA).option("multiLine", "true").json(path).select(F.explode("results").alias("r"))
    values = F.transform_values("r.extra.metavars", lambda _, v: F.struct(v["abstract_content"].alias("content"), v["propagated_value"]["svalue_abstract_content"].alias("propagated")))
    return rows.select(
        F.col("r.check_id").alias("rule_id"), F.col("r.path").alias("path"), F.col("r.start.line").alias("line"), F.col("r.start.col").alias("col"), F.col("r.end.line").alias("end_line"), F.col("r.end.col").alias("end_col"),
        F.col("r.extra.lines").alias("match"), F.upper("r.extra.severity").alias("severity"), F.col("r.extra.message").alias("message"), F.col("r.extra.metadata.crypto").alias("crypto"), F.col("r.extra.metadata.purl").alias("purl"), values.alias("metavars"),
    )


def match_errors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MATCH_SCHEMA).option("multiLine", "true").json(path).select(F.explode("errors").alias("e")).select("e.*")


_RULE = "struct<id:string,message:string,severity:string,version:string>"
REPORT_SCHEMA = (
    "version string, tool struct<name:string,version:string>, findings array<struct<file_path:string,language:string,cryptographic_assets:array<struct<"
    f"start_line:int,end_line:int,start_col:int,end_col:int,match:string,rule:{_RULE},rules:array<{_RULE}>,status:string,metadata:map<string,string>,finding_id:string,occurrence_key:string,source:string,oid:string,purl:string>>>>"
)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Assets of report documents with ``ord``; a single ``rule`` of old reports becomes the list; empty texts are null."""
    rows = spark.read.schema(REPORT_SCHEMA).option("multiLine", "true").json(path)
    found = rows.select(F.posexplode("findings").alias("i", "f")).select("i", "f.file_path", "f.language", F.posexplode("f.cryptographic_assets").alias("j", "a"))
    old = (F.coalesce(F.size("a.rules"), F.lit(0)) <= 0) & F.col("a.rule").isNotNull()
    plain = [F.nullif(F.col(f"a.{c}"), F.lit("")).alias(c) for c in ("match", "status", "finding_id", "occurrence_key", "source", "oid", "purl")]
    return found.select("file_path", "language", F.struct("i", "j").alias("ord"), "a.start_line", "a.end_line", "a.start_col", "a.end_col", *plain, F.when(old, F.array("a.rule")).otherwise(F.col("a.rules")).alias("rules"), "a.metadata")


FRAGMENT_SCHEMA = (
    "schema string, component string, strings array<string>, edges array<array<bigint>>, "
    "functions array<struct<key:string,file_path:string,start_line:int,end_line:int>>, annotations array<struct<finding_id:string,function:string,line:int>>"
)


def read_fragments(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """functions, edges and operations tables of fragment documents, one JSON document a line; edge numbers become names."""
    rows = spark.read.schema(FRAGMENT_SCHEMA).json(path)
    name = lambda i: F.get("strings", F.get("e", i).cast("int"))
    edges = rows.select("component", "strings", F.explode("edges").alias("e")).select("component", name(0).alias("caller"), name(1).alias("callee"), F.get("e", 2).alias("line"))
    return {
        "functions": rows.select("component", F.inline("functions")),
        "edges": edges,
        "operations": rows.select("component", F.inline("annotations")),
    }


# Dependencies ---------------------------------------------------------------


def go_modules(lines: DataFrame) -> DataFrame:
    """(parent, child) with versions from ``module graph`` lines "a@v b@v"."""
    p = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.size(p) == 2).select(p[0].alias("parent"), p[1].alias("child"))
    return rows.select("parent", "child", F.substring_index("child", "@", 1).alias("module"), F.nullif(F.regexp_extract("child", "@(.*)$", 1), F.lit("")).alias("version")).distinct()


CARGO_SCHEMA = "packages array<struct<id:string,name:string,version:string,manifest_path:string>>, workspace_members array<string>, resolve struct<nodes:array<struct<id:string,dependencies:array<string>>>>"


def cargo_edges(spark: SparkSession, path: str) -> DataFrame:
    """(parent, child) package ids and the child's name and version from package metadata documents."""
    rows = spark.read.schema(CARGO_SCHEMA).option("multiLine", "true").json(path)
    packages = rows.select(F.inline("packages")).select(F.col("id").alias("child"), F.col("name").alias("module"), "version").distinct()
    nodes = rows.select(F.explode("resolve.nodes").alias("n")).select(F.col("n.id").alias("parent"), F.explode("n.dependencies").alias("child"))
    return nodes.join(packages, "child", "left").select("parent", "child", "module", "version").distinct()


def maven_tree(lines: DataFrame) -> DataFrame:
    """(parent, child) coordinates of a dependency tree; depth is counted in three-character prefixes.

    lines: tree (which tree a line is of), n (its number), value.  The parent of a line
    is the last line before it that is one level up; repeats are ignored.
    """
    body = F.regexp_replace("value", r"^\[INFO\] ", "")
    rows = lines.select("tree", "n", F.regexp_extract(body, r"^((?:[|+\\ ][- ] )*)", 1).alias("prefix"), body.alias("body"))
    rows = rows.select("tree", "n", (F.length("prefix") / 3).cast("int").alias("depth"), F.expr("substring(body, length(prefix) + 1)").alias("coordinate")).where("coordinate rlike '^[^:]+:[^:]+:'")
    rows = rows.where("tree is not null and n is not null")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, number, last, waiting = None, None, {}, []  # coordinates by depth, those of the line itself held back
        for batch in batches:
            pairs = []
            for t, n, depth, coordinate in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if t != tree:
                    tree, number, last, waiting = t, n, {}, []
                elif n != number:
                    last.update(waiting)
                    number, waiting = n, []
                if depth - 1 in last:
                    pairs.append((last[depth - 1], coordinate))
                waiting.append((depth, coordinate))
            parents, children = zip(*dict.fromkeys(pairs), strict=True) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(parents, pa.string()), pa.array(children, pa.string())], ["parent", "child"])

    # A line is dealt out once, to the task that goes through its tree: lines never meet all others of a level.
    lines = rows.select("tree", "n", "depth", "coordinate").repartition("tree").sortWithinPartitions("tree", "n", "depth", "coordinate")
    return lines.mapInArrow(run, "parent string, child string").distinct()


def gradle_dependencies(rows: DataFrame) -> DataFrame:
    """One row for a coordinate of an exported list, missing paths filled from its repeats."""
    return rows.groupBy("group", "name", "version").agg(F.min("path").alias("path"), F.min("source").alias("source"))


def pip_show(blocks: DataFrame) -> DataFrame:
    """name, version, location, requires of ``show`` blocks (value: one block of "Key: value" lines)."""
    m = F.map_from_entries(F.transform(F.filter(F.split("value", "\n"), lambda x: x.contains(": ")), lambda x: F.struct(F.substring_index(x, ": ", 1).alias("k"), F.regexp_replace(x, "^[^:]*: ", "").alias("v"))))
    get = lambda k: F.try_element_at("m", F.lit(k))
    names = F.transform(F.filter(F.split(F.coalesce(get("Requires"), F.lit("")), ","), lambda x: F.trim(x) != ""), lambda x: F.regexp_replace(F.lower(F.trim(x)), "[._-]+", "-"))
    return blocks.select(m.alias("m")).where(get("Name").isNotNull()).select(F.regexp_replace(F.lower(get("Name")), "[._-]+", "-").alias("name"), get("Version").alias("version"), get("Location").alias("location"), names.alias("requires"))


#: Readers by build tool.
RESOLVERS = {"go": go_modules, "cargo": cargo_edges, "maven": maven_tree, "gradle": gradle_dependencies, "pip": pip_show}


def resolver(name: str):
    """The reader of a tool; ValueError names those that there are."""
    if name not in RESOLVERS:
        raise ValueError(f"no resolver for {name!r}; there are {', '.join(sorted(RESOLVERS))}")
    return RESOLVERS[name]


# Manifests by ecosystem, first match wins.
MANIFESTS = (
    ("go", "go.mod"), ("java", "pom.xml build.gradle build.gradle.kts settings.gradle settings.gradle.kts"), ("rust", "Cargo.toml"),
    ("python", "pyproject.toml requirements.txt Pipfile setup.py"), ("node", "package.json"),
)
# Tools that build Python packages.
PYTHON_BACKENDS = frozenset(
    "setuptools setuptools-rust maturin hatchling hatch-vcs poetry-core flit-core flit_core pdm-backend pdm_backend scikit-build scikit_build meson-python meson_python cffi".split()
)


def declares_python_package(pyproject: str | None) -> bool:
    """Whether a pyproject.toml is that of a package and not of tools only: a project table, a known build backend, or a Rust extension's tool table."""
    try:
        found = tomllib.loads(pyproject or "")
    except tomllib.TOMLDecodeError:
        return False
    table = lambda x: x if isinstance(x, dict) else {}
    build, tool = table(found.get("build-system")), table(found.get("tool"))
    if table(found.get("project")) or "maturin" in tool or "setuptools-rust" in tool:
        return True
    requires = build.get("requires") if isinstance(build.get("requires"), list) else []
    names = [str(build.get("build-backend") or "").split(".")[0], *(re.split(r"[;\[ =<>!~]", str(r).strip())[0] for r in requires)]
    return any(n.lower() in PYTHON_BACKENDS for n in names)


def detect_ecosystem(files: DataFrame, path: str = "path", root: str = "root", content: str | None = None) -> DataFrame:
    """Each root's ecosystem by the manifest that comes first in MANIFESTS.

    With the files' ``content`` a pyproject.toml that declares a package comes before
    Cargo.toml: Python packages may hold Rust.
    """
    order = {name: (i, kind) for i, (kind, names) in enumerate(MANIFESTS) for name in names.split()}
    rank = F.create_map(*[F.lit(x) for n, (i, _) in order.items() for x in (n, float(i))])
    kind = F.create_map(*[F.lit(x) for n, (_, k) in order.items() for x in (n, k)])
    name = F.substring_index(path, "/", -1)
    place = F.try_element_at(rank, name)
    if content is not None:

        @F.pandas_udf("boolean")
        def declares(texts: pd.Series) -> pd.Series:
            return texts.map(declares_python_package)

        before_rust = order["Cargo.toml"][0] - 0.5
        place = F.when(declares(F.when(name == "pyproject.toml", F.col(content))), before_rust).otherwise(place)
    return files.where(name.isin(*order)).groupBy(root).agg(F.min_by(F.try_element_at(kind, name), place).alias("ecosystem"))


# Contracts and caches --------------------------------------------------------


def merge_contracts(contracts: DataFrame) -> DataFrame:
    """One contract for method, arity and condition; ``conflict`` where libraries say different things.

    contracts: library, method, arity, condition, return_type, role.
    """
    said = F.count_distinct(F.struct(F.coalesce("return_type", F.lit("")), F.coalesce("role", F.lit(""))))
    return contracts.groupBy("method", "arity", F.coalesce("condition", F.lit("")).alias("condition")).agg(F.min("return_type").alias("return_type"), F.min("role").alias("role"), (said > 1).alias("conflict"), F.array_sort(F.collect_set("library")).alias("libraries"))


def bad_contracts(contracts: DataFrame) -> DataFrame:
    """Contracts without a method, with a negative arity, or with a confidence that isn't one; must be empty."""
    return contracts.where((F.coalesce("method", F.lit("")) == "") | (F.col("arity") < 0) | (F.col("confidence").isNotNull() & ~F.col("confidence").isin("low", "medium", "high")))


def cache_state(metadata: DataFrame, now: str = "now", strict: bool = False) -> DataFrame:
    """fresh within its time to live (24 h for latest, 7 days pinned), stale up to 30 days unless strict, else expired."""
    age = F.unix_seconds(F.col(now)) - F.unix_seconds("downloaded_at")
    ttl = F.when(F.col("version") == "latest", 86400).otherwise(7 * 86400)
    stale = F.lit(False) if strict else age <= 30 * 86400
    return metadata.withColumn("state", F.when(age <= ttl, "fresh").when(stale, "stale").otherwise("expired"))


def cached_work(wanted: DataFrame, cache: DataFrame, key: str = "cache_key", version: str = "schema_version") -> tuple[DataFrame, DataFrame]:
    """(cached rows, work still to do); another schema version is a miss."""
    hit = cache.join(wanted.select(key, version).distinct(), [key, version], "left_semi")
    return hit, wanted.join(hit.select(key, version).distinct(), [key, version], "left_anti")


def store_cache(results: DataFrame, path: str) -> None:
    """Add results to a cache folder, a sub-folder for each key; keys already there are written anew."""
    results.sparkSession.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    results.write.mode("overwrite").partitionBy("cache_key").parquet(path)


def upsert_jdbc(results: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    """Findings to a key-value table by JDBC, one document for a key and schema version: a later one takes its place.

    The rows go to a staging table from all executors; one statement of standard SQL
    then merges them by key in the database, which the staging table leaves again.
    """
    spark, staging = results.sparkSession, f"{table}_staging"
    rows = results.select("cache_key", "schema_version", F.to_json(F.struct("*")).alias("document"), F.current_timestamp().alias("stored_at"))
    keys = "cache_key varchar(128), schema_version varchar(128)"  # other text types can't be compared in every database
    rows.dropDuplicates(["cache_key", "schema_version"]).write.option("createTableColumnTypes", keys).jdbc(url, staging, "overwrite", properties)
    jvm = spark._jvm
    if driver := properties.get("driver"):
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(driver)
    own = jvm.java.util.Properties()
    for name, value in properties.items():
        own.setProperty(name, value)
    names = ("cache_key", "schema_version", "document", "stored_at")
    quoted = [f'"{n}"' for n in names]
    connection = jvm.java.sql.DriverManager.getConnection(url, own)
    try:
        statement = connection.createStatement()
        statement.executeUpdate(
            f"MERGE INTO {table} AS t USING {staging} AS s ON t.{quoted[0]} = s.{quoted[0]} AND t.{quoted[1]} = s.{quoted[1]} "
            f"WHEN MATCHED THEN UPDATE SET {quoted[2]} = s.{quoted[2]}, {quoted[3]} = s.{quoted[3]} "
            f"WHEN NOT MATCHED THEN INSERT ({', '.join(quoted)}) VALUES ({', '.join('s.' + q for q in quoted)})"
        )
        statement.executeUpdate(f"DROP TABLE {staging}")
        statement.close()
    finally:
        connection.close()


def extract_archives(archives: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """(archive, path, content) of text members with one of the extensions, of zip files read as binaryFile."""
    import io
    import zipfile
    from collections.abc import Iterator

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.infolist():
                        if m.filename.endswith(extensions) and not m.is_dir():
                            yield pd.DataFrame([(path, m.filename, z.read(m).decode("utf-8", "replace"))], columns=["archive", "path", "content"])

    return archives.select("path", "content").mapInPandas(run, "archive string, path string, content string")


def numbered_lines(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """tree, n, value: the lines of files with their numbers, for ``maven_tree``."""
    return files.select(F.col(path).alias("tree"), F.posexplode(F.split(content, "\n")).alias("n", "value"))


def last_known(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
