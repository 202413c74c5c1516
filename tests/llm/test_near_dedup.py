"""The pipeline's near-dedup stage against brute force over all pairs."""

import random

import corpus_pipeline
from weftgraph.llm import near_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_stage_drops_near_copies(spark):
    draw = random.Random(11)
    texts = {}
    for base in range(40):
        words = [f"w{draw.randrange(3000)}" for _ in range(150)]
        texts[100 * base] = " ".join(words)
        for copy in range(1, 6):  # copy changed words spoil up to five shingles each
            own = list(words)
            for at in draw.sample(range(150), copy):
                own[at] = f"x{draw.randrange(3000)}"
            texts[100 * base + copy] = " ".join(own)
    texts |= {9000: "", 9001: " \n", 9002: None, 9003: "two words", 9004: "Two  WORDS", 9005: "a b c d e", 9006: "a b c d e f"}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    rows += [(None, texts[0], "en", "s", 1), (None, None, None, None, 0), (300, texts[300], "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, None)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and len(set(ids)) == len(ids) - 1
    sets = {i: shingles(t) for i, t in texts.items()}
    near = {(i, j) for i in sets for j in sets if i < j and jaccard(sets[i], sets[j]) >= 0.8}
    assert len(near) > 150
    assert not [p for p in near if p[0] in ids and p[1] in ids]
    assert {j for _, j in near} >= set(texts) - set(ids)  # whatever went has a smaller near copy
    assert corpus_pipeline.near_duplicates(spark, spark.createDataFrame([], SCHEMA), None).count() == 0


def test_simhash_components_go_first(spark):
    draw = random.Random(5)
    words = [f"w{draw.randrange(3000)}" for _ in range(3000)]
    near = [*words[:-1], "other"]  # one shingle of some thousand: its fingerprint lies within 3 bits
    far = [f"v{draw.randrange(3000)}" for _ in range(3000)]
    texts = spark.createDataFrame([(4, " ".join(words)), (9, " ".join(near)), (2, " ".join(far))], "doc_id long, text string")
    assert [r.hi for r in near_dedup.component_copies(texts, 5, 0.8).collect()] == [9]
