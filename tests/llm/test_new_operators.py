"""Filter audit, vector codes and byte-level BPE against brute force, with nulls, ties, repeats, empties and clashing names."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from weftgraph.llm import byte_bpe, filter_audit, queries, vector_codes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    words = "the of And river STONE walks 12 a$b under it's über日本".split()
    out = [(i, " ".join(draw.choice(words[: 2 + i % 10]) for _ in range(draw.choice([3, 99, 100, 150]))), ["en", "fr", None][i % 3]) for i in range(90)]
    out += [(200 + i, out[7][1], "en") for i in range(5)] + [(300, out[7][1], None)]
    out += [(400, None, "en"), (401, "", "fr"), (402, " \t\n ", None), (None, out[7][1], "en"), (None, None, None), (5, out[5][1], "fr"), (5, out[5][1], "fr"), (5, "AAAA", "fr")]
    out += [(500, "w" * 300_000 + " x y " * 60_000, "en"), (501, " ".join(f"Word{i}" for i in range(100)), ""), (502, " ".join(f"w{i % 80}" for i in range(100)), "")]
    return [(i, t, g, "s", 1) for i, t, g in out]


@pytest.fixture(scope="module")
def labelled():
    return [(i, i % 2, int(i % 5 == 0)) for i in range(0, 520, 2)] + [(4, 1, 0), (4, None, None), (None, 1, 1), (9999, 1, 1)]


def audited(rows, labels):
    flags = defaultdict(lambda: [False, False])
    for i, q, t in labels:
        if i is not None:
            flags[i] = [flags[i][0] or q == 1, flags[i][1] or t == 1]
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    told = []
    for i, t, g, *_ in rows:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {f for f, bad in zip("ABCDE", [len(ws) < 100, 100 * len(set(ws)) < 80 * len(ws), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t]], strict=True) if bad}
        told.append((g or "", failed, *(flags[i] if i in flags else (False, False))))
    out = {}
    for part in {x[0] for x in told}:
        own = [x for x in told if x[0] == part]
        total = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                fails = sum(f in x[1] for x in own)
                out[part, "".join(order), step] = [len(left), len(gone), fails - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                total[f] += len(gone)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def test_filter_audit(spark, texts, labelled):
    docs = spark.createDataFrame(texts, SCHEMA).repartition(3)
    labels = spark.createDataFrame(labelled, "doc_id long, quality int, toxic int")
    wide = docs.withColumns({c: F.lit("x") for c in ("part", "mask", "digest", "n", "good", "labelled", "first")})
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.audit(wide, labels.withColumn("part", F.lit(1))).collect()}
    assert got == audited(texts, labelled)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    bare = filter_audit.audit(docs, labels.limit(0))
    assert bare.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0 and bare.count() == 3 * 600


def test_zeta(spark):
    counts = [random.Random(i).randrange(9) for i in range(8)]
    row = spark.range(1).select(filter_audit.zeta(F.array(*[F.lit(c).cast("long") for c in counts]), 3)).first()[0]
    assert row == [sum(c for i, c in enumerate(counts) if i & m == i) for m in range(8)]


def test_kd_tree_is_exact():
    draw = np.random.default_rng(5)
    for entries in (draw.integers(-3, 3, (256, 4)), draw.integers(-1000, 1000, (200, 16)), np.zeros((9, 2), np.int64), np.array([[5, 5]]), np.repeat(draw.integers(-2, 2, (20, 3)), 5, axis=0)):
        x = draw.integers(-4, 4, (300, entries.shape[1])) if entries.max() < 100 else draw.integers(-1000, 1000, (300, entries.shape[1]))
        far = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        got, error = vector_codes.nearest(vector_codes.kd_tree(entries), x)
        assert (got == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()


def coded(rows, entries=256, rounds=4, parts=4):
    kept = [(i, lab, [int(np.floor(1024 * x)) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][2]))[:entries]
    whole = np.array([v for _, _, v in kept]).reshape(len(kept), parts, -1)
    books = [whole[order, p].copy() for p in range(parts)]

    def near(p):
        far = ((whole[:, p, None] - books[p][None]) ** 2).sum(axis=2)
        return far.argmin(axis=1), far.min(axis=1)

    for _ in range(rounds):
        for p in range(parts):
            at, _ = near(p)
            for e in set(at.tolist()):
                books[p][e] = whole[at == e, p].sum(axis=0) // (at == e).sum()
    found = [near(p) for p in range(parts)]
    errors = sum(e for _, e in found).tolist()
    by_label = Counter()
    for (_, lab, _), e in zip(kept, errors, strict=True):
        by_label[lab] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    return Counter((i, "".join(f"{found[p][0][k]:02x}" for p in range(parts)), errors[k], by_label[lab], sha) for k, (i, lab, _) in enumerate(kept))


def test_vector_codes(spark):
    draw = np.random.default_rng(7)
    rows = [(i, draw.normal(0, 0.3, 8).round(2).tolist(), [None, 1, 2][i % 3]) for i in range(400)]
    rows += [(1000 + i, rows[3][1], 1) for i in range(150)]  # copies: ties between entries
    rows += [(None, rows[4][1], None), (7, rows[5][1], 2), (7, rows[5][1], 2), (-5, [0.0] * 8, 1), (2**60, None, 1), (600, [0.1] * 7 + [None], 1), (601, [0.1] * 7 + [float("nan")], 1), (602, [float("-inf")] + [0.1] * 7, None)]
    schema = "vec_id long, embedding array<double>, label int"
    frame = spark.createDataFrame(rows, schema).repartition(3).withColumns({c: F.lit(1) for c in ("code", "v", "of", "error")})
    out = vector_codes.compress(frame)
    assert Counter(tuple(r) for r in out.collect()) == coded(rows)
    few = rows[:20]
    assert Counter(tuple(r) for r in vector_codes.compress(spark.createDataFrame(few, schema)).collect()) == coded(few)
    assert vector_codes.compress(spark.createDataFrame([], schema)).count() == 0
    for bad in ([0.1] * 4, [1e6] + [0.1] * 7):
        with pytest.raises(Exception, match="vector"):
            vector_codes.compress(spark.createDataFrame([*few, (9_999_999, bad, 1)], schema)).collect()


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_vector_codes"])
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, sf_dir).select(want.columns).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall())


ODD = [
    None, "", " ", "  two  blanks \n\n\tx", "it's I'LL we've 12a34 ½² x\x1c\x1dy\x85z", "日本語テスト 12.5% Ünïcode ÇA", "<|endoftext|>", "a" * 70_000, "ab" * 9_000 + "é" * 500,
    "߿ԯ԰Ā࢏Ᲊ \U0002ebf0\U000116d0x", " " * 5_000 + "x", "!?" * 3_000 + "\n",
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=byte_bpe.default_pattern(), mergeable_ranks=byte_bpe.read_ranks(byte_bpe.default_path()), special_tokens={})


def test_byte_bpe(spark, texts, library):
    rows = [(i, t) for i, t, *_ in texts] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (1001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in ("ids", "n_tokens", "decoded")})
    ids = {t: library.encode_ordinary(t or "") for _, t in rows}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((i, len(ids[t]), sha(" ".join(map(str, ids[t])).encode()), sha((t or "").encode())) for i, t in rows)
    assert Counter(tuple(r) for r in byte_bpe.round_trip(docs).collect()) == want
    encoded = byte_bpe.encode(docs)
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == Counter((i, tuple(ids[t])) for i, t in rows)
    assert Counter((r.doc_id, bytes(r.decoded)) for r in byte_bpe.decode(encoded).collect()) == Counter((i, (t or "").encode()) for i, t in rows)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, 60_000, -4, 64])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded and bytes(r.decoded) for r in byte_bpe.decode(odd).collect()} == {1: None, 2: b"", 3: b"a"}
    assert byte_bpe.round_trip(docs.limit(0)).count() == 0


def test_replay_equals_library(library):
    """Random texts, vocabularies whose ranks are in no sensible order, and memos that overflow."""
    draw = random.Random(11)
    pattern = byte_bpe.default_pattern()
    own = byte_bpe.Codec(byte_bpe.read_ranks(byte_bpe.default_path()), pattern, limit=50)
    for _ in range(40):
        text = "".join(draw.choice("abcdeaaaabbes tionhe\n'1é") for _ in range(draw.randrange(1, 3_000)))
        assert own.encode([text, text[::-1]])[0].tolist() == library.encode_ordinary(text)
    for _ in range(60):
        pieces = {"".join(draw.choice("abc") for _ in range(draw.randrange(2, 6))).encode() for _ in range(60)}
        ranks = {t: i for i, t in enumerate([*(bytes([i]) for i in range(256)), *draw.sample(sorted(pieces), len(pieces))])}
        theirs, ours = tiktoken.Encoding("o", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), byte_bpe.Codec(ranks, pattern)
        for _ in range(10):
            text = " ".join("".join(draw.choice("abc") for _ in range(draw.randrange(1, 60))) for _ in range(8))
            assert ours.encode([text])[0].tolist() == theirs.encode_ordinary(text)


def test_classes_are_the_library_s():
    classes = {top: byte_bpe.Splitter(byte_bpe.default_pattern()).compiled(top) for top in (0x500, 0x10000)}
    text = "".join(chr(c) for c in range(0x20, 0x500))
    library = tiktoken.Encoding("split", pat_str=byte_bpe.default_pattern(), mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    assert "".join(classes[0x500].findall(text)) == text == library.decode(library.encode_ordinary(text))
    assert classes[0x500].findall(text) == classes[0x10000].findall(text)
