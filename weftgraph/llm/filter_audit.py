"""Interaction of quality filters: what every order of them removes, from one count per set of failed filters."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored

#: The filters' letters; the bit of a letter is its place.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
WORD_BREAK = re.compile(rb"[ \t-\r]")
MARKS = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(0x41, 0x5B))
CONTINUES = bytes(range(0x80, 0xC0))  # UTF-8 bytes that do not begin a code point


def own_failures(body: bytes, block: int = 1 << 20) -> int:
    """Bits of the filters A to D that a text fails; its words are counted ``block`` bytes at a time, its distinct words held."""
    words, distinct, at = 0, set(), 0
    while at < len(body):
        cut = WORD_BREAK.search(body, at + block)
        end = cut.start() if cut else len(body)
        part = body[at:end].split()
        words += len(part)
        distinct.update(part)
        at = end
    points = len(body.translate(None, CONTINUES))
    capitals = len(body) - len(body.translate(None, CAPITALS))
    failed = [words < 100, 100 * len(distinct) < 80 * words, 100 * capitals > 10 * points, MARKS.search(body) is not None]
    return sum(1 << i for i, f in enumerate(failed) if f)


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (bits of A to D) and digest (SHA-256) of every whole text; null texts as empty, null langs as ''."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [x.encode("utf-8", "replace") for x in batch.column("text").to_pylist()]
            masks = pa.array(map(own_failures, bodies), pa.int32())
            digests = pa.array([hashlib.sha256(b).digest() for b in bodies], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), masks, digests], ["doc_id", "part", "mask", "digest"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return named.mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def mask_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (E's bit now in it) and how many rows, good rows and toxic rows have it.

    A row fails E if its text is that of a smaller doc_id; rows without a doc_id
    never do.  Copies are counted by text and part, with the row of the smallest id
    among them, so a text that a third of all rows share is one row a part.
    """
    own = stored(failed.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n")))
    flags = labels.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).cast("long").alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    tied = own.filter("doc_id is not null").join(flags, F.col("doc_id") == F.col("labelled"), "left").na.fill(0, ["good", "toxic"])
    known = tied.groupBy("digest", "part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"), F.min(F.struct("doc_id", "n", "good", "toxic")).alias("first")
    )
    told = known.withColumn("is_first", F.col("first.doc_id") == F.min("first.doc_id").over(Window.partitionBy("digest")))
    # Of each text and part: the rows of the smallest id pass E, the others fail it.
    kept = [F.when(F.col("is_first"), x).otherwise(F.lit(0)) for x in (F.col("first.n"), F.col("first.n") * F.col("first.good"), F.col("first.n") * F.col("first.toxic"))]
    both = F.array(
        F.struct(F.col("mask"), *[k.cast("long").alias(n) for k, n in zip(kept, ("n", "good", "toxic"), strict=True)]),
        F.struct(F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"), *[(F.col(n) - k).cast("long").alias(n) for k, n in zip(kept, ("n", "good", "toxic"), strict=True)]),
    )
    alone = own.filter("doc_id is null").select("part", "mask", "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    every = told.select("part", F.inline(both)).filter("n > 0").unionByName(alone)
    return every.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def zeta(counts: Column, bits: int) -> Column:
    """From counts by mask to sums over all submasks of each mask: one pass a bit."""
    masks = F.sequence(F.lit(0), F.lit((1 << bits) - 1))
    add = lambda z, bit: F.transform(masks, lambda m: F.get(z, m) + F.when(m.bitwiseAND(bit) != 0, F.get(z, m - bit)).otherwise(0))
    return F.aggregate(F.array(*[F.lit(1 << b) for b in range(bits)]), counts, add)


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of ``filters`` and step, from ``counts(part, mask, n, good, toxic)``.

    The zeta transform turns a part's counts into the rows that fail no filter of
    a set, for every set; each step of an order is the difference of two sets that
    its filter tells apart, for labels too.  A part is one row of three arrays of
    2 ** len(filters) numbers, exploded at the end.
    """
    size, full = 1 << len(filters), (1 << len(filters)) - 1
    names = ("n", "good", "toxic")
    spread = [F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)).alias(f"{c}{m}") for c in names for m in range(size)]
    parts = counts.groupBy("part").agg(*spread).select("part", *[F.array(*[f"{c}{m}" for m in range(size)]).alias(c) for c in names])
    for c in names:
        parts = parts.withColumn(f"z_{c}", zeta(F.col(c), len(filters)))
    survive = lambda c, s: F.get(F.col(f"z_{c}"), F.lit(full).bitwiseXOR(s))
    weights = [factorial(k) * factorial(len(filters) - 1 - k) for k in range(len(filters))]
    shapley = [
        sum((weights[s.bit_count()] * (survive("n", F.lit(s)) - survive("n", F.lit(s | 1 << f))) for s in range(size) if not s >> f & 1), F.lit(0))
        for f in range(len(filters))
    ]
    parts = parts.withColumn("shapleys", F.array(*shapley))
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(filters)])).alias("filter_order")
    steps = parts.select("*", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    at = [F.instr("filter_order", f) for f in filters]
    before = sum((F.when(a < F.col("step"), F.lit(1 << i)).otherwise(F.lit(0)) for i, a in enumerate(at)), F.lit(0))
    own = F.instr(F.lit(filters), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    steps = steps.withColumns({"before": before, "own": own}).withColumn("bit", F.expr("shiftleft(1, own)"))
    with_own = F.col("before").bitwiseOR(F.col("bit"))
    lost = lambda c: survive(c, F.col("before")) - survive(c, with_own)
    fails = F.get("z_n", F.lit(full)) - survive("n", F.col("bit"))
    long = lambda c, name: c.cast("long").alias(name)
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), long(survive("n", with_own), "kept"), long(lost("n"), "removed"), long(fails - lost("n"), "redundant"),
        long(F.get("n", F.col("bit")), "unique_fails"), long(lost("good"), "good_lost"), long(lost("toxic"), "toxic_lost"), long(F.get("shapleys", F.col("own")), "shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each step of every order of the filters A to E keeps, removes and costs, per part (lang, null as '').

    A: under 100 words.  B: fewer distinct words than 80 % of all.  C: more than
    10 % capitals.  D: holds a mark of ``#$%&*|``.  E: the text of a smaller doc_id.
    Null texts count as empty; rows without a doc_id never fail E and have no
    label; rows that repeat a doc_id are each counted and never copies of one
    another; labels that repeat a doc_id count if any says so; other columns are
    not looked at; an empty table gives no rows, a table without labels zero losses.
    One text's distinct words are held at a time.
    """
    return interactions(mask_counts(failures(docs), labels))


def oracle_sql(filters: str = FILTERS) -> str:
    """The same by DuckDB: every step of every order counts over the part's masks."""
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations(filters))
    return f"""
        WITH d AS (
          SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
        ), l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
        ), m AS (
          SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                 CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * list_unique(ws) < 80 * len(ws) THEN 'B' ELSE '' END
                 || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 'C' ELSE '' END
                 || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
                 || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS failed
          FROM d LEFT JOIN l USING (doc_id)
        ), c AS MATERIALIZED (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, failed
        ), steps AS (SELECT o AS filter_order, CAST(step AS INTEGER) AS step, substr(o, step, 1) AS f, substr(o, 1, step - 1) AS prior FROM (VALUES {orders}) v(o), range(1, {len(filters) + 1}) r(step)
        ), told AS MATERIALIZED (
          SELECT part, filter_order, step, f, n, good, toxic, failed, contains(failed, f) AS hit, prior <> '' AND regexp_matches(failed, '[' || prior || '_]') AS gone FROM c, steps
        ), sums AS (
          SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant,
                 coalesce(sum(n) FILTER (failed = f), 0) AS unique_fails, coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS toxic_lost
          FROM told GROUP BY part, filter_order, step, f
        )
        SELECT part, filter_order, step, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
               CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM sums
    """
