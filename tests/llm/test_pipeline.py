"""The pipeline's stages, one after the other, against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from weftgraph.llm import langid, line_dedup, mixing, packing
from weftgraph.llm.tokenizer import default_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the river walks under bright stone and tall towers over water".split(), "fr": "le fleuve passe sous une pierre claire et des tours hautes".split()}


def prose(draw, lang, n):
    return " ".join(draw.choice(WORDS[lang]) + str(draw.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    out = [(i, prose(draw, "en" if i % 3 else "fr", 20 + i), "en" if i % 3 else "fr", f"s{i % 4}") for i in range(80)]
    out += [(100 + i, f"a Shared line \nown {prose(draw, 'en', 30)}", "en", "s1") for i in range(12)]
    out += [(200 + i, out[i][1] + " tail", "en", "s2") for i in range(20, 30)]
    out += [(300, None, "en", "s0"), (301, "12 34", None, None), (302, "", "fr", "s1"), (None, prose(draw, "fr", 30), "fr", None), (7, out[7][1], "en", "s3")]
    return out


def counted(rows):
    return Counter((r[0], r[1], r[2], r[3]) for r in rows)


def profile(texts, top=300):
    total = Counter()
    for t in texts:
        total.update(grams(t))
    return [g for g, _ in sorted(total.items(), key=lambda kv: (-kv[1], kv[0]))[:top]]


def grams(text):
    """n-grams up to 3 as packed code points; what is no letter is one boundary, written as code point 1."""
    clean = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    line, out = "\1" + "\1".join(clean) + "\1" if clean else "", Counter()
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            g = line[i : i + n]
            if g != "\1" and "\1" not in g[1:-1]:
                out[sum(ord(c) << 21 * (n - 1 - k) for k, c in enumerate(g))] += 1
    return out


def said(text, profiles, top=300):
    own = profile([text], top)
    if not own:
        return "und", 0.0
    far = {}
    for lang, keys in sorted(profiles.items()):
        place = {g: r for r, g in enumerate(keys)}
        far[lang] = sum(abs(place[g] - r) if g in place else top for r, g in enumerate(own)) / (top * len(own))
    best = min(sorted(far), key=far.get)
    return best, 1 - far[best]


def learned(rows):
    by = defaultdict(list)
    for i, t, lang, _ in rows:
        if i is not None and t is not None and lang is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            by[lang].append(t)
    return {lang: profile(texts) for lang, texts in by.items()}


def test_language_against_brute_force(spark, rows):
    every = [*rows, (900, "zzz", "aa", "s"), (903, "zzz", "bb", "s"), (906, "zzz", "cc", "s")]
    docs = spark.createDataFrame([(*r, 0) for r in every], SCHEMA).repartition(3)
    profiles = learned(every)
    got = langid.fit_profiles(docs)
    assert {lang: keys.tolist() for lang, keys in got.items()} == profiles
    out = Counter((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(docs).collect())
    assert out == Counter((i, lang, round(score, 9)) for i, t, _, _ in every for lang, score in [said(t, profiles)])
    tied = {r.lang_pred for r in langid.identify(docs).filter("doc_id >= 900").collect()}
    assert tied == {min(set(profiles) & {"aa", "bb", "cc"})}
    assert set(langid.fit_profiles(docs, languages=1)) == {max(["en", "fr"], key=lambda x: sum(r[2] == x for r in every))}


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b) if a or b else True


def test_stages_against_brute_force(spark, rows):
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    profiles = learned(rows)
    known = [r for r in rows if said(r[1], profiles)[0] != "und"]
    assert counted(stages["language_id"](spark, docs, None).collect()) == counted(known) and len(known) == len(rows) - 3

    after = spark.createDataFrame([(*r, len(r[1] or "")) for r in known], SCHEMA)
    keys = Counter(k for _, t, _, _ in known for k in set(line_dedup.line_keys(t)[1]))
    first = {k: min(i for i, t, _, _ in known if i is not None and k in line_dedup.line_keys(t)[1]) for k, n in keys.items() if n >= 10}
    assert first == {b"a shared line": 100}
    want = [(i, t if i == 100 or i is None or "Shared" not in t else t.split("\n")[1], lang, s) for i, t, lang, s in known]
    assert counted(stages["line_dedup"](spark, after, None).collect()) == counted(want)

    after = spark.createDataFrame([(*r, len(r[1])) for r in want], SCHEMA)
    named = {i: t for i, t, _, _ in want if i is not None}
    sets = {i: shingles(t) for i, t in named.items()}
    stay = []
    for i in sorted(named):
        if not any(alike(sets[i], sets[j]) for j in stay):
            stay.append(i)
    got = stages["simhash"](spark, after, None).collect()
    assert Counter(r.doc_id for r in got) == Counter([*stay, None]) and len(stay) < len(named)

    kept = [(r.doc_id, r.text, r.lang, r.source) for r in got]
    mixed = stages["mixing"](spark, spark.createDataFrame([(*r, len(r[1])) for r in kept], SCHEMA), None).collect()
    size, taken = Counter(), Counter()
    for _, t, _, s in kept:
        size[s] += len(t.split())
    for r in mixed:
        taken[r.source] += len(r.text.split())
    assert max(counted(mixed).values()) <= 3 and set(counted(mixed)) <= set(kept)
    aims = mixing.targets(dict(size))
    assert all(abs(taken[s] - aims[s]) <= 0.1 * aims[s] for s in aims)

    from tokenizers import Tokenizer

    whole, want = Tokenizer.from_file(default_path()), Counter()
    for r in mixed:
        ids, start = [*whole.encode(r.text, add_special_tokens=False).ids, 2], 0
        for n in packing.binary_lengths(len(ids), 4096):
            want[(r.doc_id, start, tuple(ids[start : start + n]))] += 1
            start += n
    pieces = stages["packing"](spark, spark.createDataFrame(mixed, SCHEMA), None).collect()
    assert Counter((r.doc_id, r.start, tuple(r.ids)) for r in pieces) == want


def test_run_follows_the_stages(spark, rows, tmp_path):
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    whole = defaultdict(int)
    for r in out.select("doc_id", "length").collect():
        whole[r.doc_id] += r.length
    assert whole and not {300, 301, 302} & set(whole)
    assert [f[0] for f in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash", "mixing", "packing"]


def test_stages_on_an_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, None)
        assert out.count() == 0 and (name == "packing" or out.columns == none.columns), name
