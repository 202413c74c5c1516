"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, unused, widened

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int], weights: dict[str | None, float] | None = None, share: float = 1.0, most: float = 3.0) -> dict[str | None, float]:
    """Each source's target size.

    Without ``weights``, sources in code-point order, null last, weigh 1, 2, 3,
    repeating.  ``share`` of all sizes is shared by weight; a source stops at
    ``most`` times its size and the excess is shared anew among the others until
    none is above.
    """
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weights = weights or {s: float(i % 3 + 1) for i, s in enumerate(names)}
    left, out, active = share * sum(sizes.values()), {}, list(names)
    while active:
        total = sum(weights[s] for s in active)
        over = [s for s in active if total <= 0 or left * weights[s] / total > most * sizes[s]]
        if not over:
            out.update({s: left * weights[s] / total for s in active})
            break
        for s in over:
            out[s] = most * float(sizes[s])
            left -= out[s]
        active = [s for s in active if s not in over]
    return out


def pair(p: np.ndarray, mass: np.ndarray, ids: Sequence[int], seed: int) -> tuple[np.ndarray, int | None]:
    """Round fractions to 0 or 1 pair by pair, keeping sum(p * mass); returns them and the index of the one left over.

    Two fractional entries trade mass at random until one is integral, with odds
    that keep each one's expectation; the other meets the next entry.
    """
    p = p.astype(float).copy()
    held = None
    for j in range(len(p)):
        if not 0.0 < p[j] < 1.0:
            continue
        if held is None:
            held = j
            continue
        i = held
        up = min((1 - p[i]) * mass[i], p[j] * mass[j])
        down = min(p[i] * mass[i], (1 - p[j]) * mass[j])
        u = xxhash.xxh64_intdigest(int(ids[i]).to_bytes(8, "little", signed=True) + int(ids[j]).to_bytes(8, "little", signed=True), seed) / 2.0**64
        if u * (up + down) < down:
            first = up == (1 - p[i]) * mass[i]
            p[i], p[j] = (1.0, p[j] - up / mass[j]) if first else (p[i] + up / mass[i], 0.0)
        else:
            first = down == p[i] * mass[i]
            p[i], p[j] = (0.0, p[j] + down / mass[j]) if first else (p[i] - down / mass[i], 1.0)
        held = j if first else i
        if not 1e-12 < p[held] < 1 - 1e-12:
            p[held], held = round(p[held]), None
    return p, held


def settle_with(seed: int):
    """A function that rounds the fractions p of one group of units and marks in open the one left over; a source's last one is drawn."""

    def settle(group: pa.Table) -> pa.Table:
        column = {c: group.column(c).to_numpy() for c in ("p", "size", "n", "id", "groups")}
        ids = group.column("doc_id")
        order = np.lexsort((column["n"], ids.fill_null(0).to_numpy(), column["id"], -column["size"]))
        p, held = pair(column["p"][order], (column["size"] * column["n"])[order].astype(float), column["id"][order], seed)
        open_ = np.zeros(len(p), bool)
        if held is not None:
            open_[held] = True
            if column["groups"][0] == 1:
                u = xxhash.xxh64_intdigest(int(column["id"][order][held]).to_bytes(8, "little", signed=True), seed + 1) / 2.0**64
                p[held], open_[held] = float(u < p[held]), False
        group = group.take(pa.array(order))
        at = group.schema.get_field_index("p")
        return group.set_column(at, group.schema.field(at), pa.array(p)).append_column("open", pa.array(open_))

    return settle


def rounded(units: DataFrame, most_groups: int, fanout: int, seed: int) -> list[DataFrame]:
    """The units with p rounded, as parts: groups round among themselves, and their leftovers meet again by ``fanout``, level by level."""
    done, level = [], units
    while True:
        out = checkpoint(level.groupBy("source", "part").applyInArrow(settle_with(seed), widened(level.schema, open="boolean")))
        done.append(out.filter("not open").drop("open"))
        if most_groups <= 1:
            return done
        most_groups = math.ceil(most_groups / fanout)
        level = out.filter("open").drop("open").withColumns({"groups": F.ceil(F.col("groups") / fanout).cast("int"), "part": F.floor(F.col("part") / fanout).cast("int")})


def copies(
    docs: DataFrame, weights: dict[str | None, float] | None = None, share: float = 1.0, most: float = 3.0, seed: int = 17, group: int = 1000, fanout: int = 1000
) -> DataFrame:
    """How often each document is taken: doc_id, source, size, n (rows alike), source_size, target and copies.

    Rows that agree in doc_id, source and size are one unit and share its
    copies.  A source's rate is target over size; a unit takes the whole part and
    the fraction is rounded dependently so that the source's words stay at its
    target.  Units of like size are rounded together, the largest sizes first:
    hash groups of about ``group`` units among themselves, then what each leaves,
    ``fanout`` by ``fanout``, until a source has one fraction left, which is drawn.
    What that draw takes too much or too little is spread over the rates of all
    smaller units, so a source ends about one of its smallest units away from its
    target, and each unit keeps its expected copies.

    Only one row per source and size class (powers of four) reaches the driver.
    Sizes count words; null and empty texts have none and take part with 0 words.
    Null sources are a source of their own, null ids a unit per size.  An empty
    table gives an empty one.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    cells = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    mass = F.col("size") * F.col("n")
    units = checkpoint(cells.withColumn("id", F.xxhash64("doc_id", "size", F.lit(seed))).withColumn("like", F.when(mass > 0, F.floor(F.log2(mass) / 2)).otherwise(-1).cast("int")))
    held = {(r["source"], r["like"]): (r["words"], r["units"]) for r in units.groupBy("source", "like").agg(F.sum(mass).alias("words"), F.count("*").alias("units")).collect()}
    words: dict[str | None, int] = {}
    for (source, _), (n, _) in held.items():
        words[source] = words.get(source, 0) + n
    aims = targets(words, weights, share, most)
    done, ahead, left = [], dict.fromkeys(words, 0.0), dict(words)
    for like in sorted({k for _, k in held}, reverse=True):
        plan = []
        for (source, own), (n, count) in held.items():
            if own == like:
                even = min(most, aims[source] / words[source]) if words[source] else 0.0
                rate = min(most, max(0.0, even - ahead[source] / left[source])) if left[source] else 0.0
                plan.append((source, words[source], float(aims[source]), rate, max(1, math.ceil(count / group))))
                ahead[source] -= even * n
                left[source] -= n
        table = spark.createDataFrame(plan, "from_source string, source_size long, target double, rate double, groups int")
        rated = (
            units.filter(F.col("like") == like)
            .join(F.broadcast(table), F.col("source").eqNullSafe(F.col("from_source")))
            .withColumns({"whole": F.floor("rate").cast("int"), "p": F.col("rate") - F.floor("rate"), "part": F.pmod("id", "groups").cast("int")})
            .drop("from_source", "rate", "like")
        )
        parts = rounded(rated, max(r[4] for r in plan), fanout, seed)
        every = parts[0]
        for more in parts[1:]:
            every = every.unionByName(more)
        done.append(every.withColumn("copies", (F.col("whole") + F.col("p")).cast("int")))
        for source, taken in done[-1].groupBy("source").agg(F.sum(F.col("copies") * mass)).collect():
            ahead[source] += taken
    if not done:
        return units.select("doc_id", "source", "size", "n", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).alias("copies"))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.select("doc_id", "source", "size", "n", "source_size", "target", "copies")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target and taken, the words that the mix takes of it.

    Nulls, repeated rows, ties and empty tables: see ``copies``.
    """
    rows = copies(docs, **options).withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it.

    Documents without words are kept once; columns are as in ``docs``, whatever
    they are called.  Nulls, repeated rows and empty tables: see ``copies``.
    """
    names = [unused(docs.columns, c) for c in ("own_id", "own_source", "own_size", "own_copies", "own_copy")]
    own_id, own_source, own_size, own_copies, own_copy = names
    often = F.when(F.col("size") > 0, F.col("copies")).otherwise(1)
    taken = copies(docs, **options).select(F.col("doc_id").alias(own_id), F.col("source").alias(own_source), F.col("size").alias(own_size), often.alias(own_copies))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    on = F.col("doc_id").eqNullSafe(F.col(own_id)) & F.col("source").eqNullSafe(F.col(own_source)) & (size == F.col(own_size))
    joined = docs.join(taken.filter(F.col(own_copies) > 0), on)
    return joined.withColumn(own_copy, F.explode(F.sequence(F.lit(1), F.col(own_copies)))).select(*docs.columns)
