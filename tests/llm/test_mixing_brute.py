"""The mix against a plain version: targets by water filling, then units rounded one pair after the other."""

import math
import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F
from weftgraph.llm import mixing

SEED = 17


def plain_targets(sizes):
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full: set = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        aim = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if aim[s] > 3 * sizes[s]}
        if not over:
            return aim | {s: 3.0 * sizes[s] for s in full}
        full |= over


def draw(seed, *ids):
    return xxhash.xxh64_intdigest(b"".join(i.to_bytes(8, "little", signed=True) for i in ids), seed) / 2**64


def plain_round(units):
    """Copies beyond the whole part, for (p, mass, id) in order; what is left at the end is drawn."""
    p, held = [u[0] for u in units], None
    for j, (_, mass, own) in enumerate(units):
        if not 0 < p[j] < 1:
            continue
        if held is None:
            held = j
            continue
        i, (_, other_mass, other) = held, units[held]
        rise, fall = (1 - p[i]) * other_mass, p[i] * other_mass
        up, down = min(rise, p[j] * mass), min(fall, (1 - p[j]) * mass)
        moved = up if draw(SEED, other, own) * (up + down) < down else -down
        settled_i = moved in (rise, -fall)
        if settled_i:
            p[i], p[j] = float(moved > 0), p[j] - moved / mass
        else:
            p[i], p[j] = p[i] + moved / other_mass, float(moved < 0)
        held = j if settled_i else i
        if not 1e-12 < p[held] < 1 - 1e-12:
            p[held], held = float(round(p[held])), None
    if held is not None:
        p[held] = float(draw(SEED + 1, units[held][2]) < p[held])
    return p


def plain_mix(rows, ids):
    """Counter of (doc_id, size, source_size, target, taken)."""
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    cells = Counter((i, s, size(t)) for i, t, s in rows)
    held = Counter()
    for (_, s, n), times in cells.items():
        held[s] += n * times
    aims, out = plain_targets(held), Counter()
    for source in held:
        classes = {}
        for (i, s, n), times in cells.items():
            if s == source:
                classes.setdefault(math.floor(math.log2(n * times) / 2) if n else -1, []).append((-n, ids[i, n], i or 0, times, i))
        ahead, left = 0.0, held[source]
        even = min(3.0, aims[source] / left) if left else 0.0
        for like in sorted(classes, reverse=True):
            units = sorted(classes[like], key=lambda u: u[:4])
            rate = min(3.0, max(0.0, even - ahead / left)) if left else 0.0
            whole = math.floor(rate)
            up = plain_round([(rate - whole, float(-n * times), own) for n, own, _, times, _ in units])
            words = sum(-n * times for n, _, _, times, _ in units)
            taken = sum((whole + int(p)) * -n * times for p, (n, _, _, times, _) in zip(up, units, strict=True))
            ahead, left = ahead - even * words + taken, left - words
            for p, (n, _, _, times, i) in zip(up, units, strict=True):
                out[i, -n, held[source], round(aims[source], 6), (whole + int(p)) * -n] += times
    return out


def test_mix_equals_plain_version(spark):
    take = random.Random(11)
    text = lambda: " ".join("w" for _ in range(int(take.paretovariate(0.6)) % 3000))
    rows = [(i, text(), take.choice(["a", "a", "a", "b", "c", "ß", None])) for i in range(500)]
    rows += [(None, "x y", "b"), (None, "x y", "b"), (None, None, None), (3, None, "a"), (7, "", "only empty"), rows[5], rows[5], (1 << 60, "u v\x0bw x", "c")]
    rows += [(None, None, None)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    sizes = docs.select("doc_id", F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long").alias("size")).distinct()
    ids = {(r.doc_id, r["size"]): r.id for r in sizes.withColumn("id", F.xxhash64("doc_id", "size", F.lit(SEED))).collect()}
    got = Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.mix_report(docs).collect())
    assert got == plain_mix(rows, ids)
