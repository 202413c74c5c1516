"""Text files as path and text, and pools of code files by glob."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def text_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path (below ``root``) and text (UTF-8, one leading BOM stripped) of every file whose name fits ``glob``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = F.lit(re.sub(r"^\w+://", "", root).rstrip("/"))
    bare = F.regexp_replace("path", r"^\w+:/*", "/")
    at = F.instr(bare, base)
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "")
    return found.select(F.substring(bare, at + F.length(base) + 1, F.length(bare)).alias("path"), text.alias("text"))


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob with ``**``, ``*``, ``?`` and ``{a,b}``."""
    out, depth, i = "", 0, 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        c = glob[i]
        if glob.startswith("**", i):
            out, i = out + ".*", i + 1
        elif c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def in_pool(path: Column, globs: list[str]) -> Column:
    """Whether a path fits one of ``globs`` and none of those that start with ``!``."""
    fits, out = F.lit(False), F.lit(False)
    for g in globs:
        if g.startswith("!"):
            out = out | path.rlike(glob_pattern(g[1:]))
        else:
            fits = fits | path.rlike(glob_pattern(g))
    return fits & ~out


def code_files(files: DataFrame, include: list[str], tests: list[str]) -> DataFrame:
    """Files of either pool, with is_test: membership of the second.  Exclusions hold inside their own pool only."""
    return files.withColumn("is_test", in_pool(F.col("path"), tests)).filter(F.col("is_test") | in_pool(F.col("path"), include))
