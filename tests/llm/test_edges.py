"""Large, null and negative ids in one batch, and input columns named like the operators' own."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from weftgraph.llm import embeddings, langid, line_dedup, mixing, near_dedup, queries, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
IDS = [2**60 + 1, None, -7, 2**60 + 3, 5]
TEXTS = ["the river walks under a stone", "the river walks under a stone now", "le fleuve passe sous la pierre", None, "the tall tower\nstands"]
CLASHES = "n n_lines n_dropped lang_pred score own own_id own_source own_size own_copies own_copy keys path suspect digest row message h fp root like p".split()


@pytest.fixture(scope="module")
def few(spark):
    rows = [(i, t, "fr" if "fleuve" in (t or "") else "en", "s", 1) for i, t in zip(IDS, TEXTS, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


@pytest.fixture(scope="module")
def folder(few, tmp_path_factory):
    path = tmp_path_factory.mktemp("ids")
    few.write.parquet(f"{path}/documents.parquet")
    return str(path)


#: Queries over vectors, or whose rows are no documents.
OTHERS = {"op9_embedding_dedup", "op11_filter_audit", "op12_vector_codes"}


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in OTHERS])
def test_query_keeps_ids(spark, folder, name):
    out = queries.QUERIES[name](spark, folder).select("doc_id").distinct().collect()
    assert {r.doc_id for r in out} == set(IDS)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_keeps_ids(spark, few, name, stage):
    out = [r.doc_id for r in stage(spark, few, None).select("doc_id").distinct().collect()]
    gone = {"language_id": {2**60 + 3}}.get(name, set())
    assert set(out) == set(IDS) - gone if name != "mixing" else set(out) <= set(IDS)


def test_vector_ids(spark):
    rows = [(2**60 + 1, [1.0, 2.0]), (None, [1.0, 2.0]), (-7, [-1.0, 2.0]), (2**60 + 3, None)]
    out = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in out) == Counter(
        [(2**60 + 1, 1, 2**60 + 1, True), (None, 1, 2**60 + 1, False), (-7, 0, -7, True), (2**60 + 3, 0, 2**60 + 3, True)]
    )


def test_double_vectors_keep_their_digits(spark):
    a = np.array([1.0, 0.0])
    b = np.array([0.95, np.sqrt(1 - 0.95**2)])
    for wanted, angle in ((1, 0.95 - 1e-12), (0, 0.95 + 1e-12)):
        rows = [(1, a.tolist()), (2, b.tolist())]
        out = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), least_cosine=angle).collect()
        assert [r.n_links for r in out] == [wanted, wanted]


def test_clashing_columns(spark, few):
    wide = few
    for i, c in enumerate(CLASHES):
        wide = wide.withColumn(c, few["n_chars"] + i)
    stages = {
        "known": langid.keep_known(wide),
        "lines": line_dedup.dedup_lines(wide, documents=2, counts=False),
        "lines by join": line_dedup.dedup_lines(wide, documents=2, counts=False, broadcast_limit=0),
        "one": simhash.keep_one(wide),
        "unlike": near_dedup.keep_unlike(wide),
        "mix": mixing.mix(wide),
    }
    for name, out in stages.items():
        assert out.columns == wide.columns, name
        rows = out.collect()
        assert rows and all(r[c] == 1 + i for r in rows for i, c in enumerate(CLASHES)), name
    said = langid.predict(wide, langid.fit_profiles(wide)).collect()
    assert len(said) == 5 and all(r.n == 1 and r.own_id == 7 for r in said) and {r.lang_pred for r in said} == {"en", "fr", "und"}
    counted = line_dedup.dedup_lines(wide, documents=2).collect()
    assert sorted(r.n_lines for r in counted) == [1, 1, 1, 1, 2] and all(r.n == 1 for r in counted)


def test_no_shared_folder_on_a_cluster():
    from weftgraph.llm.common import shared_folder

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(ValueError):
        shared_folder(Session())
