"""Each operator against a brute-force version, with nulls, empties, ties, repeats and clashing names."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from weftgraph.llm import embeddings, exact_dedup, langid, line_dedup, lm_score, mixing, packing, sharding, simhash, token_counts
from weftgraph.llm.tokenizer import ChunkTokenizer, default_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], schema)


def prose(seed, n, vocabulary="the of and river stone walks under bright tall over a it"):
    words = vocabulary.split()
    draw = random.Random(seed)
    return " ".join(draw.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    out = [(i, prose(i, 5 + i % 40) + f" {i}.", "en", f"s{i % 3}") for i in range(60)]
    out += [(100 + i, out[3][1], "en", "s0") for i in range(12)]
    out += [(200, None, None, None), (201, "", "fr", None), (202, " \t\n ", "fr", "s1"), (203, "12 34 !!", None, "s2")]
    out += [(None, "no id at all", "en", "s1"), (None, None, None, None), (5, out[5][1], "en", "s2"), (5, out[5][1], "en", "s2")]
    out += [(300 + i, f"Shared LINE \n own line {i}\n  shared line", "en", "s1") for i in range(11)]
    out += [(400, "é" * 50 + " " + "word " * 30_000, "fr", "s2"), (401, "Ünïcode ÇA va's don't <|endoftext|> x  日本語 テスト 12.5%", "fr", "s0")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return documents(spark, rows).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def test_sharding(spark, docs, rows, none):
    out = sharding.shard_documents(docs).collect()
    assert len(out) == len(rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == sizes
    assert sharding.shard_documents(none).count() == 0


def test_sharding_draws(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")

    def python_shard(key, node):
        while node.shard is None:
            def score(c):
                h = xxhash.xxh64_intdigest(key.to_bytes(8, "little"), xxhash.xxh64_intdigest(c.name.encode(), 42))
                return -math.log(((h >> 11) + 0.5) / 2**53) / c.total
            node = min(node.children, key=score) if len(node.children) > 1 else node.children[0]
        return node.shard

    tree = sharding.shard_tree(8)
    got = {r.doc_id: r.shard for r in sharding.shard_rows(ids, tree).collect()}
    assert all(got[i] == python_shard(i, tree) for i in range(500))
    assert max(Counter(got.values()).values()) < 1.1 * 20_000 / 8
    for n in (8, 9, 10, 13):
        moved = sharding.shard_rows(ids, sharding.shard_tree(n), sharding.shard_tree(n + 1)).filter("shard <> grown_shard")
        assert {r.grown_shard for r in moved.select("grown_shard").distinct().collect()} == {n}
        assert abs(moved.count() - 20_000 / (n + 1)) < 300
    # A changed weight inside a region moves rows only on that path.
    heavy = sharding.shard_tree(8, weights={0: 3.0})
    moved = sharding.shard_rows(ids, tree, heavy).filter("shard <> grown_shard and shard < 4 and grown_shard >= 4")
    assert moved.count() == 0


def naive_grams(text):
    clean = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = Counter()
    for w in clean:
        out.update((c,) for c in w)
    line = "\1" + "\1".join(clean) + "\1" if clean else ""
    for n in (2, 3):
        out.update(tuple(line[i : i + n]) for i in range(len(line) - n + 1) if "\1" not in line[i + 1 : i + n - 1])
    pack = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return {pack(g): n for g, n in out.items()}


def test_language_grams():
    for text in ("", "a", "Hello, World!", "l'été à l'école", "12", "straße ΑΣ x", prose(1, 300)):
        keys, counts = langid.grams(text)
        assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == naive_grams(text)
        order = sorted(naive_grams(text).items(), key=lambda kv: (-kv[1], kv[0]))[:20]
        assert langid.ranked(keys, counts, 20).tolist() == [k for k, _ in order]


def test_language(spark, docs, rows, none):
    out = langid.identify(docs).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    for r in out:
        assert r.lang_pred in ("en", "fr", "und") and 0 <= r.score <= 1
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    und = {r.doc_id for r in out if r.lang_pred == "und"}
    assert und == {200, 201, 202, 203, None}
    assert langid.identify(none).count() == 0
    assert langid.keep_known(docs).columns == docs.columns


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert out.filter("lang = lang_pred").count() / out.count() > 0.97


def test_tokenizer_is_exact(rows):
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(default_path()), ChunkTokenizer(default_path(), limit=50)
    texts = [t or "" for _, t, _, _ in rows] + ["ÀÉ ÿ Ÿ ß ÷ × a\x1cb c\xa0d", "it's IT'S 'tis ... a.b", "x<|startoftext|>y", "İ Σ ΑΣ é"]
    for t in texts:
        assert own.ids(t).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_packing(spark, docs, rows, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_path())
    out = packing.pack(docs).collect()
    assert sorted(r.sequence_id for r in out) == list(range(len(out)))
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 4096 for r in out)
    by_id = sorted(out, key=lambda r: r.sequence_id)
    assert [r.length for r in by_id] == sorted((r.length for r in out), reverse=True)
    want = Counter()
    for i, t, _, _ in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        start = 0
        for n in packing.binary_lengths(len(ids), 4096):
            want[(i, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids))] += 1
            start += n
        assert start == len(ids)
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == want
    assert packing.pack(none).count() == 0


def test_golomb():
    draw = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 1000, 50_000):
        values = np.unique(draw.integers(0, 2**64, n, dtype=np.uint64))
        data = exact_dedup.golomb_encode(values)
        assert (exact_dedup.golomb_decode(data) == values).all()
        if n >= 50_000:
            assert len(data) < 6.7 * n
    for values in ([5, 6, 7], [0, 2**64 - 1], [1, 2, 2**63]):
        values = np.array(values, np.uint64)
        assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(values)) == values).all()


def test_exact_dedup(spark, docs, rows, none):
    import hashlib

    out = exact_dedup.exact_groups(docs).collect()
    groups = defaultdict(list)
    for i, t, _, _ in rows:
        groups[t or ""].append(i)
    want = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            want[(i, max(known) if known else None, len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == want
    kept = Counter(r.text_sha256 for r in out if r.kept)
    assert len(kept) == len(groups) and set(kept.values()) == {1}
    assert all(r.doc_id == r.keep_id for r in out if r.kept)
    assert exact_dedup.exact_groups(none).count() == 0


def test_line_dedup(spark, docs, rows, none):
    want = Counter(line_dedup.brute_force([(i, t) for i, t, _, _ in rows]))
    for options in ({}, {"broadcast_limit": 0}, {"bits": 1 << 10}):
        out = line_dedup.line_report(docs, **options).collect()
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in out) == want
    assert line_dedup.line_report(none).count() == 0


@pytest.mark.parametrize("limit", [0, 1000])
def test_line_dedup_first(spark, docs, limit):
    out = line_dedup.dedup_lines(docs, keep_first=True, broadcast_limit=limit)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    text = {r.doc_id: r.text for r in out.filter("doc_id >= 300 and doc_id < 400").collect()}
    assert text[300] == "Shared LINE \n own line 0" and text[301] == " own line 1"
    clash = docs.withColumnsRenamed({"lang": "n_lines", "source": "digest"})
    assert line_dedup.dedup_lines(clash, broadcast_limit=limit).count() == docs.count()


def test_token_counts(spark, docs, rows, none):
    pieces = token_counts.vocabulary(default_path())
    out = Counter((r.doc_id, r.n_words, r.n_tokens) for r in token_counts.count_tokens(docs).collect())
    memo = {}
    for w in {w for _, t, _, _ in rows for w in (t or "").encode().lower().split()}:
        memo[w] = token_counts.brute_force(w, pieces)
    assert out == Counter((i, len(ws), sum(memo[w] for w in ws)) for i, t, _, _ in rows for ws in [(t or "").encode().lower().split()])
    assert token_counts.count_tokens(none).count() == 0


def test_longest_match_random():
    draw = random.Random(8)
    for _ in range(300):
        pieces = {bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 5))) for _ in range(draw.randint(1, 12))}
        automaton = token_counts.LongestMatch(pieces)
        for _ in range(20):
            word = bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 12)))
            assert automaton.count(word) == token_counts.brute_force(word, pieces), (pieces, word)


def test_mixing_targets():
    aims = mixing.targets({"a": 100, "b": 100, None: 1000, "c": 10})
    assert list(aims) and aims["c"] == 30 and aims["b"] <= 300 and abs(sum(aims.values()) - 1210) < 1e-6
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_mixing(spark, docs, rows, none):
    out = mixing.mix_report(docs, group=7, fanout=3).collect()
    size = lambda t: len((t or "").encode().split())
    assert Counter((r.doc_id, r.size) for r in out) == Counter((i, size(t)) for i, t, _, _ in rows)
    assert all(r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0) for r in out)
    again = mixing.mix_report(docs.repartition(3), group=7, fanout=3).collect()
    assert Counter(out) == Counter(again)
    assert mixing.mix_report(none).count() == 0
    many = documents(spark, [(i, prose(i, 1 + i % 200), "en", f"s{i % 7}") for i in range(5000)])
    taken, aim = Counter(), {}
    source = {i: f"s{i % 7}" for i in range(5000)}
    for r in mixing.mix_report(many, group=50, fanout=4).collect():
        taken[source[r.doc_id]] += r.taken
        aim[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - t) <= 5 for s, t in aim.items())
    mixed = mixing.mix(many)
    assert mixed.columns == many.columns and abs(mixed.count() - 5000) < 500


def test_pivotal_keeps_mass_and_odds():
    mass = np.array([9.0, 7, 5, 3, 3, 2, 1])
    share, hits = np.array([0.3, 0.6, 0.5, 0.2, 0.9, 0.4, 0.7]), np.zeros(7)
    for seed in range(4000):
        p, held = mixing.pair(share, mass, list(range(7)), seed)
        assert abs((p * mass).sum() - (share * mass).sum()) < 1e-9
        hits += p
    assert np.abs(hits / 4000 - share).max() < 0.03


def naive_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_bit_sliced_comparison():
    draw = np.random.default_rng(5)
    values = draw.integers(0, 2**64, 300, dtype=np.uint64)
    values[200:] = values[:100] ^ (np.uint64(1) << draw.integers(0, 64, 100, dtype=np.uint64)) ^ (np.uint64(1) << draw.integers(0, 64, 100, dtype=np.uint64))
    for radius in (0, 1, 2, 3, 5, 7):
        got = set(zip(*map(np.ndarray.tolist, simhash.near(values, values, radius, rows=100)), strict=True))
        want = {(i, j) for i in range(300) for j in range(300) if bin(int(values[i] ^ values[j])).count("1") <= radius}
        assert got == want


def test_simhash(spark, docs, rows, none):
    base = prose(77, 400)
    near = [(500 + i, base.replace("river", "river", i) + f" tail{i}", "en", "s0") for i in range(30)]
    every = [*rows, *near]
    out = simhash.near_groups(documents(spark, every)).collect()
    prints = [(i, naive_fingerprint(t)) for i, t, _, _ in every]
    assert Counter((r.doc_id, r.fingerprint) for r in out) == Counter((i, f"{p:016x}") for i, p in prints)
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in distinct:
        for b in distinct:
            if bin(a ^ b).count("1") <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(least.get(find(p), i), i)
    assert Counter((r.doc_id, r.component_id) for r in out) == Counter((i, least.get(find(p))) for i, p in prints)
    assert simhash.near_groups(none).count() == 0
    kept = simhash.keep_one(documents(spark, every))
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([*least.values(), None, None])


def test_tiles_lose_no_link(spark):
    draw = np.random.default_rng(6)
    centre = draw.integers(0, 2**64, dtype=np.uint64)
    values = [int(centre ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b))) for a in range(64) for b in range(a)]
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), tile=50)
    from weftgraph.llm.links import components

    assert components(found).select("root").distinct().count() == 1


def test_components(spark):
    from weftgraph.llm.links import components

    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(260 - 1, -5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == -5 for i in [7, *range(200, 260)])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings(spark):
    draw = np.random.default_rng(7)
    base = draw.standard_normal((400, 64)).astype(np.float32)
    close = base[:60] + 0.12 * draw.standard_normal((60, 64)).astype(np.float32)
    hub = base[399] + 0.1 * draw.standard_normal((80, 64)).astype(np.float32)
    vectors = np.concatenate([base, close, hub, base[:5], 2 * base[5:8]])
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    bad = [(9000, None, 1), (9001, [], 1), (9002, [0.0] * 64, 1), (9003, [float("nan")] * 64, 1), (9004, [None] + [1.0] * 63, 1), (9005, [float("inf")] * 64, 1), (9006, [0.0] * 64, 1)]
    out = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int"), tile=30).collect()}
    assert len(out) == len(rows) + len(bad)
    assert all(out[i].n_links == 0 and out[i].component_id == i and out[i].kept for i, _, _ in bad)
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95) & ~np.eye(len(unit), dtype=bool)
    found = sum(out[i].n_links for i in range(len(vectors)))
    assert all(out[i].n_links <= links[i].sum() for i in range(len(vectors)))
    assert found >= 0.98 * links.sum()
    assert all(out[i].component_id == i for i in range(len(vectors)) if not links[i].any())
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_vectors(empty).count() == 0


def test_embedding_recall(spark):
    """Pairs planted just above the threshold among 20,000 vectors."""
    draw = np.random.default_rng(17)
    base = draw.standard_normal((18_000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = draw.standard_normal((2000, 64))
    other -= (other * base[:2000]).sum(axis=1, keepdims=True) * base[:2000]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = draw.uniform(0.9505, 0.965, (2000, 1))
    vectors = np.concatenate([base, cosine * base[:2000] + np.sqrt(1 - cosine**2) * other])
    assert not ((base[:3000] @ base.T >= 0.95).sum(axis=1) > 1).any()
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(frame).collect()}
    found = sum(got[18_000 + i] == (1, i) for i in range(2000))
    assert found >= 0.97 * 2000
    assert all(got[i][0] == 0 for i in range(2000, 18_000))


def test_mixing_meets_targets_on_documents(spark):
    for sf, most in (("sf0.01", 0.01), ("sf0.1", 0.001)):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        got = mixing.mix_report(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
        assert all(abs(r["sum(taken)"] - r["max(target)"]) <= most * r["max(target)"] for r in got)


@pytest.mark.parametrize("hot", [0, 50, 10**6])
@pytest.mark.parametrize("order", [2, 3])
def test_lm_score(spark, docs, rows, none, hot, order):
    made = ChunkTokenizer(default_path())
    ids = [(i, [lm_score.START] * (order - 1) + made.ids(t).tolist()) for i, t, _, _ in rows]
    grams = [Counter() for _ in range(order + 1)]
    for _, x in ids:
        for at in range(order - 1, len(x)):
            for k in range(1, order + 1):
                grams[k][tuple(x[at - k + 1 : at + 1])] += 1
    context = [Counter() for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, n in grams[k].items():
            context[k][g[:-1]] += n
    want = Counter()
    for i, x in ids:
        total = 0
        for at in range(order - 1, len(x)):
            for k in range(order, 0, -1):
                g = tuple(x[at - k + 1 : at + 1])
                if grams[k][g] >= (2 if k > 1 else 1):
                    total += round(math.log(grams[k][g] / context[k][g[:-1]]) * 1e6) + (order - k) * round(math.log(0.4) * 1e6)
                    break
        want[(i, len(x) - order + 1, total)] += 1
    out = lm_score.score_documents(docs, order=order, least=2, hot_share=hot).collect()
    got = Counter((r.doc_id, r.n_tokens, round(r.log_score * 1e6)) for r in out)
    assert got == want
    assert all((r.mean_score is None) == (r.n_tokens == 0) for r in out)
    assert lm_score.score_documents(none, order=order, least=2, hot_share=hot).count() == 0
