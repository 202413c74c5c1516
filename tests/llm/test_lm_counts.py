"""op10_lm_score against brute force: every count above 0 is scored, and what the model has not seen backs off."""

import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from weftgraph.llm import lm_score, queries
from weftgraph.llm.tokenizer import ChunkTokenizer, default_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = {1: "the river walks under the stone", 2: "the river walks over a tall bright stone", 3: "once", 4: "", 5: None, 6: "the river " * 30, 7: "a red bridge over the river", 8: "the stone walks", 9: "zebras walk under a bridge"}


def brute_force(order, learned=lambda i: True):
    """Scores of all texts by a model of the learned ones, and how many n-grams were backed off."""
    made = ChunkTokenizer(default_path())
    ids = {i: [lm_score.START] * (order - 1) + made.ids(t).tolist() for i, t in TEXTS.items()}
    counts, context = [Counter() for _ in range(order + 1)], [Counter() for _ in range(order + 1)]
    for i, x in ids.items():
        for at in range(order - 1, len(x)) if learned(i) else ():
            for k in range(1, order + 1):
                g = tuple(x[at - k + 1 : at + 1])
                counts[k][g] += 1
                context[k][g[:-1]] += 1
    out, off = {}, 0
    for i, x in ids.items():
        total = 0
        for at in range(order - 1, len(x)):
            for k in range(order, 0, -1):
                g = tuple(x[at - k + 1 : at + 1])
                if counts[k][g] or k == 1:
                    p = counts[k][g] / context[k][g[:-1]] if counts[k][g] else 1 / max(1, sum(counts[1].values()))
                    total += round(math.log(p) * 1e6) + (order - k) * round(math.log(0.4) * 1e6)
                    break
                off += 1
        out[i] = (len(x) - order + 1, total)
    return out, off


def documents(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in TEXTS.items()], SCHEMA)


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("hot", [0, 50])
def test_every_count_is_scored(spark, order, hot):
    out = lm_score.score_documents(documents(spark), order=order, least=1, hot_share=hot).collect()
    assert {r.doc_id: (r.n_tokens, round(r.log_score * 1e6)) for r in out} == brute_force(order)[0]


def test_query_backs_off(spark, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op10_lm_score(spark, str(tmp_path)).collect()
    want, off = brute_force(2, lambda i: zlib.crc32(str(i).encode()) % 3 != 1)
    assert off > 0 and {r.doc_id: (r.n_tokens, round(r.log_score * 1e6)) for r in out} == want


def test_nothing_learned(spark):
    out = lm_score.score_documents(documents(spark), order=2, least=1, learn=F.lit(False)).collect()
    assert {r.doc_id: (r.n_tokens, round(r.log_score * 1e6)) for r in out} == brute_force(2, lambda i: False)[0]
