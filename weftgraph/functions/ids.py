"""Requirement ids in text: column functions over the id grammar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The id grammar.
TOKEN = r"[A-Z][A-Za-z]*-\d+"
NAMESPACED = rf"(?:[\w-]+/)?(?:{TOKEN})"


def title_tags(title: Column) -> Column:
    """Distinct ``[ns/ID]`` tags of a title, in order; null titles have none."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(rf"\[((?:[^\]/]+/)?{TOKEN})\]"), F.lit(1)))


def inherited_tags(title: Column, ancestors: Column) -> Column:
    """The title's tags, or where it has none those of its ancestors."""
    own, above = title_tags(title), F.coalesce(ancestors, F.array().cast("array<string>"))
    return F.when(F.size(own) > 0, own).otherwise(F.array_distinct(F.flatten(F.transform(above, title_tags))))


def escaped(text: Column) -> Column:
    """Text as a literal inside a regular expression."""
    return F.regexp_replace(text, r"([^A-Za-z0-9])", r"\\$1")


def mentions(text: Column, id_: Column) -> Column:
    """Whether the whole id stands in the text, bounded by no letter, digit or underscore."""
    return F.rlike(text, F.concat(F.lit("(?<![A-Za-z0-9_])"), escaped(id_), F.lit("(?![A-Za-z0-9_])")))


def index_mentions(texts: DataFrame, ids: DataFrame, key: str, id_: str) -> DataFrame:
    """The pairs (key, id) of which the id is mentioned in the text: ``texts(key, text)``, ``ids(id)``; as ``mentions`` tells, without a pattern an id.

    Every text is cut once into words and what stands between them.  Runs of as
    many words as some id has are entered with what stands around them and joined
    to the ids by their words; an id that begins or ends with other characters
    must find these around the run, with no word touching them.  An id without a
    letter, digit or underscore is mentioned nowhere.
    """
    word = r"[A-Za-z0-9_]+"
    bare = lambda c: F.regexp_replace(c, r"^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$", "")
    own = ids.select(F.col(id_).alias("__id")).distinct().withColumns({"__core": bare(F.col("__id")), "__size": F.size(F.regexp_extract_all("__id", F.lit(word), F.lit(0)))})
    own = own.withColumns({"__head": F.regexp_extract("__id", r"^([^A-Za-z0-9_]*)", 1), "__tail": F.regexp_extract("__id", r"([^A-Za-z0-9_]*)$", 1)})
    sizes = [r[0] for r in own.filter("__size > 0").select("__size").distinct().collect()]  # as many as an id has words at most
    body = F.coalesce("text", F.lit(""))
    cut = texts.select(F.col(key).alias("__key"), F.regexp_extract_all(body, F.lit(word), F.lit(0)).alias("w"), F.split(body, word, -1).alias("s"))
    unit = F.zip_with("w", F.slice("s", 2, F.size("w")), lambda w, s: F.concat(w, s))
    cut = cut.withColumn("u", unit).withColumn("n", F.size("w"))
    found = None
    for size in sizes or [1]:
        at = F.explode(F.sequence(F.lit(1), F.col("n") - size + 1)).alias("i")
        runs = cut.filter(F.col("n") >= size).select("__key", "w", "s", "u", at)
        core = F.concat(F.array_join(F.slice("u", F.col("i"), size - 1), ""), F.get("w", F.col("i") + (size - 2)))
        last = F.col("i") + size == F.size("s")
        part = runs.select("__key", core.alias("__core"), F.get("s", F.col("i") - 1).alias("before"), F.get("s", F.col("i") + (size - 1)).alias("after"), (F.col("i") == 1).alias("begins"), last.alias("ends")).distinct()
        found = part if found is None else found.unionByName(part)
    fits = (F.col("__head") == "") | F.endswith("before", "__head") & ((F.length("before") > F.length("__head")) | F.col("begins"))
    fits = fits & ((F.col("__tail") == "") | F.startswith("after", "__tail") & ((F.length("after") > F.length("__tail")) | F.col("ends")))
    hits = found.join(own.filter("__size > 0"), "__core").filter(fits).select("__key", "__id")
    return hits.distinct().select(F.col("__key").alias(key), F.col("__id").alias(id_))


def plain_path(path: Column) -> Column:
    """A relative path without ``.``, empty and ``..`` segments; null if it leaves the root or is absolute."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != ".") & (s != ""))
    down = lambda acc, s: (
        F.when(acc.isNull() | ((s == "..") & (F.size(acc) == 0)), F.lit(None).cast("array<string>"))
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s)))
    )
    return F.when(path.startswith("/"), F.lit(None).cast("string")).otherwise(F.array_join(F.aggregate(parts, F.array().cast("array<string>"), down), "/"))
