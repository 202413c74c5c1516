"""Names that ``export *`` hands on: which of them come from exactly one place, over any graph of star exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import Levels, stored

CHAINS = T.StructType().add("id", "long").add("name", "string").add("chain", T.ArrayType(T.LongType()))


def providers(symbols: DataFrame, stars: DataFrame, most: int = 16) -> DataFrame:
    """path, name and target of the names that a file hands on from one target: ``symbols(path, name)``, ``stars(path, target)``.

    A file hands on a name that it does not declare, never ``default``, if exactly
    one way without repeats leads over star exports to a file that declares it:
    none or several give nothing.  Ways are never listed.  A pair (file, name)
    holds the chain of files, from the declaring one, that all its ways end in;
    it has one way if its chain ends in the file itself, else several.  Chains are
    cut at ``most`` files; pairs whose chain was cut go on from the file that it
    ends in, in one more pass.  Files that nobody exports are told by their
    targets alone, at last.
    """
    spark = symbols.sparkSession
    steps = stored(stars.filter("path <> target").select("path", "target").distinct())
    inner = stored(steps.select(F.col("target").alias("path")).distinct().withColumn("id", F.monotonically_increasing_id()))
    fan = F.count("*").over(Window.partitionBy("path"))
    steps = stored(steps.join(inner.toDF("target", "aim"), "target").join(inner, "path", "left").select("path", "id", "aim", fan.alias("n")))
    edges = stored(steps.filter("id is not null").select("id", "aim"))
    own = symbols.filter("name <> 'default'").select("path", "name").distinct()
    home = stored(own.join(inner, "path").select("id", "name"))

    settled = Levels(spark, T.StructType().add("id", "long").add("name", "string").add("target", "long").add("one", "boolean"))
    settled.add(home.select("id", "name", F.lit(None).cast("long").alias("target"), F.lit(True).alias("one")))
    waiting, fresh = None, home
    while not fresh.isEmpty():
        told = stored(_chains(edges, fresh, waiting, most))
        one, cut = F.try_element_at("chain", F.lit(-1)).eqNullSafe(F.col("id")), F.size("chain") == most
        settled.add(told.filter(one | ~cut).select("id", "name", F.when(one, F.try_element_at("chain", F.lit(-2))).alias("target"), one.alias("one")))
        fresh = told.filter(cut & one).select("id", "name")
        waiting = told.filter(cut & ~one).select("id", "name")

    ends = settled.all()
    within = ends.filter("one and target is not null").join(inner, "id").join(inner.toDF("to", "target"), "target").select("path", "name", F.col("to").alias("target"))
    ways = steps.filter("id is null").join(ends.select(F.col("id").alias("aim"), "name", "one"), "aim").filter("n > 1 or one")
    single = ways.groupBy("path", "name").agg(F.count("*").alias("ways"), F.min("one").alias("one"), F.min("aim").alias("aim")).filter("ways = 1 and one")
    outer = single.join(own, ["path", "name"], "anti").join(inner.toDF("target", "aim"), "aim").select("path", "name", "target")
    return within.unionByName(outer)


def _chains(edges: DataFrame, origins: DataFrame, among: DataFrame | None, most: int) -> DataFrame:
    """id, name and chain of the pairs from which ``edges(id, aim)`` lead to ``origins(id, name)``, those among the pairs ``among`` if given, the origins left out.

    A round tells the pairs before those that changed: a chain that ends in its own
    file goes on by the one that hears it, others are handed on as they are, and
    what all that a pair has heard begin with is its chain, so it only gets shorter.
    """
    found = Levels(edges.sparkSession, CHAINS)
    changed = found.add(origins.select("id", "name", F.array("id").alias("chain")))
    grown = F.when((F.try_element_at("chain", F.lit(-1)) == F.col("aim")) & (F.size("chain") < most), F.concat("chain", F.array("id"))).otherwise(F.col("chain"))
    equal = F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b))
    # The least and the greatest of some arrays begin alike as far as all of them do.
    alike = F.when(F.array_position(equal, False) > 0, F.slice("low", 1, (F.array_position(equal, False) - 1).cast("int"))).otherwise(F.col("low"))
    while changed:
        heard = edges.join(found.last().withColumnRenamed("id", "aim"), "aim").select("id", "name", grown.alias("chain"))
        if among is not None:
            heard = heard.join(among, ["id", "name"], "semi")
        heard = stored(heard.groupBy("id", "name").agg(F.min("chain").alias("low"), F.max("chain").alias("high")))
        before = found.all().join(heard.select("id", "name"), ["id", "name"], "semi")
        both = heard.select("id", "name", "low", "high", F.lit(None).cast("array<long>").alias("old")).unionByName(before.select("id", "name", F.col("chain").alias("low"), F.col("chain").alias("high"), F.col("chain").alias("old")))
        now = both.groupBy("id", "name").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("old").alias("old")).withColumn("chain", alike)
        changed = found.add(now.filter("old is null or get(old, 0) is not null and get(old, 0) <> id and size(chain) < size(old)"))
    return found.all().groupBy("id", "name").agg(F.min("chain").alias("chain")).filter("get(chain, 0) is null or get(chain, 0) <> id")
