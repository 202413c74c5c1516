"""The pipeline's packing stage writes the token ids themselves."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from weftgraph.llm import packing
from weftgraph.llm.tokenizer import default_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stage_holds_every_id(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_path())
    texts = {1: "one two three", 2: "", 3: None, 4: "word stone " * 4000, 5: "Bright tall river, it's under a stone."}
    rows = [(i, t, "en", "s", 0) for i, t in texts.items()]
    rows += [rows[4], rows[4], (None, "no id", "en", "s", 0)]  # mixing repeats documents
    out = corpus_pipeline.packed(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), None).collect()
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for i, t, *_ in rows}
    want = Counter()
    for i, *_ in rows:
        start = 0
        for n in packing.binary_lengths(len(ids[i]), 4096):
            want[(i, start, tuple(ids[i][start : start + n]))] += 1
            start += n
    assert Counter((r.doc_id, r.start, tuple(r.ids)) for r in out) == want
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in out)
    assert sorted(r.sequence_id for r in out) == list(range(len(out)))
    assert [r.length for r in sorted(out, key=lambda r: r.sequence_id)] == sorted((r.length for r in out), reverse=True)
