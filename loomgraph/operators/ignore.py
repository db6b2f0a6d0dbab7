"""Ignore rules: which paths a tree's rule files leave out.

A rule file holds ordered patterns for the folder that it lies in: blank lines and those with # are none; ! takes back;
a pattern with a slash before its end is anchored at the folder, one without is for any depth below; / at the end is for
folders only; * and ? stop at slashes, ** does not; [a-z] and [!a-z] are classes and \\ takes the next character as it is.
Of the rules that match, the last of the deepest folder decides.  What is in an ignored folder is ignored, whatever
rules say of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def translated(line: str) -> tuple[str, bool, bool] | None:
    """(regular expression for paths below the folder, takes back, folders only) of a line; None if it is no rule."""
    line = line.rstrip("\r\n")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[back:]
    folders = line.endswith("/")
    line = line.rstrip("/") if folders else line
    anchored = "/" in line
    line = line.removeprefix("/")
    if not line:
        return None
    out, i = "" if anchored else "(?:.*/)?", 0
    while i < len(line):
        c = line[i]
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif line[i:] == "**" and i and line[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := line.find("]", i + 2)) > 0:
            inner = line[i + 1 : end]
            out += "(?!/)[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", r"\\").replace("[", r"\[").replace("&", r"\&") + "]"
            i = end + 1
        else:
            if c == "\\" and i + 1 < len(line):
                i += 1
                c = line[i]
            out, i = out + (c if re.fullmatch(r"\w|/", c) else "\\" + c if c.isascii() else c), i + 1
    return f"^{out}$", back, folders


def compiled(rules: DataFrame) -> DataFrame:
    """(scope, rules): of (scope, position, line) one row for each folder, its rules in order; scope '' is the root. Null and blank lines are no rules."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(s, p, *t) for s, p, x in zip(*(c.to_pylist() for c in batch.columns), strict=True) if x and (t := translated(x))]
            yield pa.RecordBatch.from_pylist([dict(zip(("scope", "position", "pattern", "back", "folders"), f, strict=True)) for f in found], schema=pa.schema([("scope", pa.string()), ("position", pa.int64()), ("pattern", pa.string()), ("back", pa.bool_()), ("folders", pa.bool_())]))

    one = rules.select(F.coalesce("scope", F.lit("")).alias("scope"), F.col("position").cast("long"), "line").mapInArrow(go, "scope string, position long, pattern string, back boolean, folders boolean")
    return one.groupBy("scope").agg(F.sort_array(F.collect_list(F.struct("position", "pattern", "back", "folders"))).alias("rules"))


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, ignored) for distinct files (path, with / between names and none at the ends) under rules (scope, position, line).

    Each folder is decided once, however many files it holds; a path meets one row for each folder above it that has
    rules.  Null and empty paths are left out.
    """
    parts = F.split("path", "/")
    files = paths.select("path").where("path <> ''").distinct()
    upto = lambda k: F.array_join(F.slice(parts, 1, k), "/")
    steps = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(upto(k).alias("at"), (k < F.size(parts)).alias("folder")))).alias("s")).select("path", "s.at", "s.folder")
    names = F.split("at", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda k: F.struct(k.alias("depth"), F.when(k == 0, "").otherwise(F.array_join(F.slice(names, 1, k), "/")).alias("scope"), F.array_join(F.slice(names, k + 1, F.size(names)), "/").alias("below")))
    asked = steps.select("at", "folder").distinct().select("at", "folder", F.explode(above).alias("a")).select("at", "folder", "a.depth", "a.scope", "a.below")
    fits = F.filter("rules", lambda r: F.rlike(F.col("below"), r["pattern"]) & (F.col("folder") | ~r["folders"]))
    met = asked.join(compiled(rules), "scope").withColumn("last", F.try_element_at(fits, F.lit(-1)))
    decided = met.where("last is not null").groupBy("at", "folder").agg(F.max_by("last.back", "depth").alias("back")).where("not back").select("at", "folder")
    lost = steps.join(decided, ["at", "folder"], "left_semi").select("path").distinct().withColumn("ignored", F.lit(True))
    return files.join(lost, "path", "left").select("path", F.coalesce("ignored", F.lit(False)).alias("ignored"))
