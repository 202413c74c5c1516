"""What a relative specifier stands for: configurations that extend one another, package manifests, ranked candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import plain_path
from ..graph import stored

# Settings of jsx that allow it.
JSX = ["preserve", "react", "react-native", "react-jsx", "react-jsxdev"]


@dataclass(frozen=True)
class Options:
    """What a project's configuration lets a specifier stand for."""

    jsx: bool = False
    allow_js: bool = False
    resolve_json: bool = False


def without_comments(text: Column) -> Column:
    """JSON text without comments and trailing commas; strings stay as they are."""
    bare = F.regexp_replace(text, r"(\"(?:\\.|[^\"\\])*\")|//[^\n]*|/\*[\s\S]*?(?:\*/|\z)", "$1")
    return F.regexp_replace(bare, r"(\"(?:\\.|[^\"\\])*\")|,(?=\s*[}\]])", "$1")


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*?)[^/]*$", 1)


def effective_options(files: DataFrame) -> DataFrame:
    """path, jsx, allow_js and resolve_json of every configuration in ``files(path, text)``, with what it inherits.

    An option is that of the nearest configuration up the ``extends`` chain that
    states it.  Chains are shortened by pointer jumping: each round takes over the
    parent's options and points to the parent's parent, so a chain of n takes
    log2(n) rounds; a cycle ends when all its members have heard each other.
    """
    parsed = files.filter(F.col("path").endswith(".json")).select("path", F.try_parse_json(without_comments(F.col("text"))).alias("v")).filter("v is not null")
    get = lambda p, kind: F.try_variant_get("v", f"$.{p}", kind)
    stated = lambda p: F.try_variant_get("v", f"$.compilerOptions.{p}", "variant").isNotNull()
    jsx = F.when(stated("jsx"), F.coalesce(F.lower(get("compilerOptions.jsx", "string")).isin(JSX), F.lit(False)))
    flag = lambda p: F.when(stated(p), F.coalesce(F.schema_of_variant(F.try_variant_get("v", f"$.compilerOptions.{p}", "variant")) == "BOOLEAN", F.lit(False)) & F.coalesce(get(f"compilerOptions.{p}", "boolean"), F.lit(False)))
    own = stored(parsed.select("path", get("extends", "string").alias("extends"), jsx.alias("jsx"), flag("allowJs").alias("allow_js"), flag("resolveJsonModule").alias("resolve_json")))
    # A relative one is a file, with or without its ending; a package is looked for in every folder above.
    near = F.array(plain_path(F.concat(folder(F.col("path")), "extends")))
    parts = F.filter(F.split(folder(F.col("path")), "/"), lambda x: x != "")
    above = F.transform(F.sequence(F.size(parts), F.lit(0)), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.when(n > 0, "/").otherwise("")))
    packages = F.transform(above, lambda a: F.concat(a, F.lit("node_modules/"), "extends"))
    ends = F.when(F.col("extends").startswith("."), F.array(F.lit(""), F.lit(".json"))).otherwise(F.array(F.lit(""), F.lit(".json"), F.lit("/tsconfig.json")))
    bases = F.when(F.col("extends").startswith("."), near).otherwise(packages)
    tries = own.filter("extends is not null").select("path", F.posexplode(F.flatten(F.transform(bases, lambda b: F.transform(ends, lambda e: F.concat(b, e))))).alias("rank", "parent"))
    known = tries.join(own.select(F.col("path").alias("parent")), "parent").groupBy("path").agg(F.min_by("parent", "rank").alias("parent"))
    names = ("jsx", "allow_js", "resolve_json")
    chain, rounds = stored(own.drop("extends").join(known, "path", "left")), max(1, own.count()).bit_length()
    for _ in range(rounds):
        up = chain.select(F.col("path").alias("parent"), F.col("parent").alias("next"), *[F.col(n).alias(f"up_{n}") for n in names])
        chain = stored(chain.join(up, "parent", "left").select("path", F.nullif(F.col("next"), F.col("path")).alias("parent"), *[F.coalesce(n, f"up_{n}").alias(n) for n in names]))
        if chain.filter("parent is not null").isEmpty():
            break
    return chain.select("path", *[F.coalesce(n, F.lit(False)).alias(n) for n in names])


def project_options(files: DataFrame, path: str = "tsconfig.json") -> Options:
    """The options of one configuration of ``files``, defaults where there is none."""
    row = effective_options(files).filter(F.col("path") == path).first()
    return Options(row.jsx, row.allow_js, row.resolve_json) if row else Options()


def as_file(path: Column, options: Options) -> Column:
    """The files that a path may stand for, best first: structs of target and ok, whether the options allow it."""
    one = lambda target, ok=True: F.struct(target.alias("target"), F.lit(ok).alias("ok"))
    cut = lambda n: F.substring(path, F.lit(1), F.length(path) - n)

    def probed(base: Column) -> Column:
        more = [".js"] * options.allow_js + [".jsx"] * (options.allow_js and options.jsx)
        return F.array(*[one(F.concat(base, F.lit(e)), e != ".tsx" or options.jsx) for e in (".ts", ".tsx", ".d.ts", *more)])

    listed = lambda base, *ends: F.array(*[one(F.concat(base, F.lit(e))) for e in ends])
    return (
        F.when(path.endswith(".tsx"), F.array(one(path, options.jsx)))
        .when(path.rlike(r"\.[mc]?ts$"), F.array(one(path)))
        .when(path.endswith(".json"), F.array(one(path, options.resolve_json)))
        .when(path.rlike(r"\.jsx?$"), probed(F.regexp_replace(path, r"\.jsx?$", "")))
        .when(path.endswith(".mjs"), listed(cut(4), ".mts", ".d.mts", *[".mjs"] * options.allow_js))
        .when(path.endswith(".cjs"), listed(cut(4), ".cts", ".d.cts", *[".cjs"] * options.allow_js))
        .otherwise(probed(path))
    )


def package_targets(files: DataFrame) -> DataFrame:
    """folder and entry of every ``package.json`` that names one: its types, else its main file."""
    parsed = files.filter(F.col("path").rlike(r"(?:^|/)package\.json$")).select("path", F.try_parse_json("text").alias("v"))
    text = lambda p: F.when(F.schema_of_variant(F.try_variant_get("v", f"$.{p}", "variant")) == "STRING", F.try_variant_get("v", f"$.{p}", "string"))
    entry = F.coalesce(text("types"), text("typings"), text("main"))
    return parsed.select(F.regexp_replace(folder(F.col("path")), "/$", "").alias("folder"), entry.alias("entry")).filter("entry is not null")


def targets(specs: DataFrame, files: DataFrame, options: Options = Options(), modules: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """``specs(path, spec)`` with target: the file among ``files(path, text)`` that a relative specifier stands for.

    First the path as a file, then what the manifest of a folder of that name
    says, then the folder's index.  In each of these the best file that is there
    counts, and gives nothing if the options do not allow it.  With
    ``modules(path)`` a target that is no module and no JSON gives nothing.  All
    candidates are exploded with their rank and joined to the files at once.
    """
    full = plain_path(F.concat(folder(F.col("path")), "spec"))
    named = specs.select("path", "spec").distinct().withColumn("full", full).filter("full is not null")
    named = named.join(package_targets(files).withColumnRenamed("folder", "full"), "full", "left")
    none = F.array().cast("array<struct<target:string,ok:boolean>>")
    stages = [
        F.when(F.col("spec").endswith("/"), none).otherwise(as_file(F.col("full"), options)),
        F.when(F.col("entry").isNull(), none).otherwise(as_file(plain_path(F.concat("full", F.lit("/"), "entry")), options)),
        as_file(F.concat("full", F.lit("/index")), options),
    ]
    ranked = lambda i: F.transform(stages[i], lambda c, n: F.struct(F.lit(i).alias("stage"), n.alias("rank"), c["target"].alias("target"), c["ok"].alias("ok")))
    tries = F.concat(*[ranked(i) for i in range(len(stages))])
    there = named.select("path", "spec", F.inline(tries)).join(files.select(F.col("path").alias("target")).distinct(), "target")
    of = lambda c, i: F.when(F.col("stage") == i, c)
    best = there.groupBy("path", "spec").agg(*[F.min_by(of(F.struct("target", "ok"), i), of(F.col("rank"), i)).alias(f"s{i}") for i in range(len(stages))])
    out = best.select("path", "spec", F.coalesce(*[F.when(F.col(f"s{i}.ok"), F.col(f"s{i}.target")) for i in range(len(stages))]).alias("target")).filter("target is not null")
    if modules is not None:
        fine = modules.select(F.col("path").alias("target"), F.lit(True).alias("is_module")).distinct()
        out = out.join(fine, "target", "left").filter("is_module or endswith(target, '.json')").select("path", "spec", "target")
    return out
