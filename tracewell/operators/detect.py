"""Line rules over text: the detection front end and what turns matches into assets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.ids import finding_id
from tracewell.functions.text import relative_path, strip_longest_prefix


@dataclass(frozen=True)
class Rule:
    """A line rule: a regular expression in the subset that Java and RE2 share."""

    id: str
    pattern: str
    severity: str = "info"
    languages: tuple[str, ...] = ()
    message: str = ""
    metadata: dict[str, str] = field(default_factory=dict, hash=False)


def rules_for(rules: Sequence[Rule], languages: Sequence[str]) -> list[Rule]:
    """Rules that name one of the languages or none at all; where none is left, all of them."""
    wanted = {x.lower() for x in languages}
    kept = [r for r in rules if not r.languages or wanted & {x.lower() for x in r.languages}]
    return kept or list(rules)


#: Code points that are no characters: they mark matches inside a line.
_BEGIN, _END = "\ufdd0", "\ufdd1"


def match_places(content: Column, pattern: str) -> Column:
    """array<struct<col, len>> of all matches in order, from 1; empty ones left out.

    The matches are marked, and the marked text is cut at the marks: a place is the
    length of all that comes before.
    """
    marked = F.regexp_replace(F.translate(content, _BEGIN + _END, "\ufffd\ufffd"), F.lit(pattern), F.lit(f"{_BEGIN}$0{_END}"))
    parts = F.split(marked, _BEGIN, -1)
    sizes = F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda p: F.struct(F.length(F.substring_index(p, _END, 1)).alias("len"), (F.length(p) - 1).alias("whole")))
    none = F.array().cast("array<struct<col:int,len:int>>")
    start = F.struct((F.length(parts[0]) + 1).alias("at"), none.alias("out"))
    step = lambda s, x: F.struct((s["at"] + x["whole"]).alias("at"), F.concat(s["out"], F.array(F.struct(s["at"].alias("col"), x["len"].alias("len")))).alias("out"))
    places = F.aggregate(sizes, start, step, lambda s: s["out"])
    return F.when(content.rlike(pattern), F.filter(places, lambda x: x["len"] > 0)).otherwise(none)


def detect_lines(texts: DataFrame, rules: Sequence[Rule], path: str | Column = "path", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """path, line and col (both from 1), match, rule_id, severity of every match of each rule on each line.

    Matches of one rule don't overlap; empty ones don't count.  Rules are literals of
    one pass over the lines; a null text has no lines.  ``keep`` columns come along.
    """
    p = F.col(path) if isinstance(path, str) else path
    lines = texts.select(p.alias("path"), *keep, F.posexplode(F.split(text, "\n")).alias("pos", "content"))
    wanted = F.lit(False)
    for r in rules:
        wanted = wanted | F.col("content").rlike(r.pattern)
    each = F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.upper(F.lit(r.severity)).alias("severity"), match_places(F.col("content"), r.pattern).alias("places")) for r in rules])
    found = lines.where(wanted).select("path", *keep, (F.col("pos") + 1).cast("long").alias("line"), "content", F.explode(each).alias("m"))
    found = found.select("path", *keep, "line", "content", "m.rule_id", "m.severity", F.explode("m.places").alias("at"))
    return found.select("path", *keep, "line", F.col("at.col").cast("long").alias("col"), F.substring("content", F.col("at.col"), F.col("at.len")).alias("match"), "rule_id", "severity")


def to_assets(matches: DataFrame, root: str = "", rule_prefixes: Sequence[str] = ()) -> DataFrame:
    """Matches as assets: path below the root, trimmed match, cleaned rule id, one-rule list, status pending, finding id."""
    rule = strip_longest_prefix(F.col("rule_id"), rule_prefixes)
    rows = matches.withColumn("file_path", relative_path("path", F.lit(root)) if root else F.col("path")).withColumn("rule_id", rule)
    return rows.select(
        "file_path",
        F.col("line").alias("start_line"),
        F.col("line").alias("end_line"),
        F.col("col").alias("start_col"),
        (F.col("col") + F.length("match")).alias("end_col"),
        F.trim("match").alias("match"),
        "rule_id",
        "severity",
        F.array(F.struct(F.col("rule_id").alias("id"), "severity")).alias("rules"),
        F.lit("pending").alias("status"),
        finding_id("file_path", "line", "rule_id").alias("finding_id"),
    )


def detect_languages(files: DataFrame, extensions: dict[str, str], path: str = "path") -> DataFrame:
    """language, n_files by file extension, most files first, then by name."""
    table = F.create_map(*[F.lit(x) for p in extensions.items() for x in p])
    lang = F.try_element_at(table, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))
    return files.select(lang.alias("language")).where("language is not null").groupBy("language").agg(F.count("*").alias("n_files")).orderBy(F.desc("n_files"), "language")
