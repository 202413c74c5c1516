"""Long texts are counted in blocks: the same results, and memory that holds a block, not the text's n-grams."""

import random
import tracemalloc
from collections import Counter

import pytest
import xxhash
from weftgraph.llm import langid, simhash


def plain_grams(text):
    """All n-grams by strings: letters, with one boundary for every other run."""
    shape = "".join(c if c.isalpha() else "\x01" for c in "\x01" + text.lower() + "\x01")
    while "\x01\x01" in shape:
        shape = shape.replace("\x01\x01", "\x01")
    found = Counter()
    for size in (1, 2, 3):
        for i in range(len(shape) - size + 1):
            piece = shape[i : i + size]
            if piece != "\x01" and not (size == 3 and piece[1] == "\x01"):
                found[sum(ord(c) << langid.BITS * (size - 1 - k) for k, c in enumerate(piece))] += 1
    return dict(found)


def plain_fingerprint(text, words=3):
    own = (text or "").encode("utf-8", "replace").lower().split()
    if not own:
        return 0
    parts = [b" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))]
    ones = Counter(b for p in parts for h in [xxhash.xxh64_intdigest(p, 42)] for b in range(64) if h >> b & 1)
    value = sum(1 << b for b in range(64) if 2 * ones[b] > len(parts))
    return value - (1 << 64) if value >= 1 << 63 else value


TEXTS = ["", " ", "..", "a", "ab", " a b ", "A-b--c, d", "日本語 ΣΑΣ ß İx", "one two", "one  two\tthree\x0bfour\r\n", "x\x1cy\x85z 　 w"]
TEXTS += ["".join(random.Random(i).choice("ab c-\n\tÉß") for _ in range(5 + 13 * i)) for i in range(12)]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_blocks_change_nothing(block):
    for text in TEXTS:
        keys, counts = langid.grams(text, block=block)
        assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == plain_grams(text)
        assert list(keys) == sorted(keys)
        assert simhash.fingerprint(text, block=block) == plain_fingerprint(text)
        assert simhash.fingerprint(text, words=1, block=block) == plain_fingerprint(text, 1)


@pytest.mark.parametrize(("count", "times"), [(langid.grams, 4), (simhash.fingerprint, 8)])
def test_memory_of_a_long_text(count, times):
    text = " ".join(random.Random(3).choices([f"word{i}" for i in range(1000)], k=1_500_000))
    langid.letter_table()
    tracemalloc.start()
    count(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < times * len(text) + 60_000_000
