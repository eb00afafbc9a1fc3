"""BPE round trips, differencing and decontamination against brute force."""

import heapq
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import bpe, decontaminate, sharding
from siftline.llm import textkit as tk

ALPHABET = "ab  \n\t'sdtlve.,!?0123é日本🙂  ÀZ"


@pytest.fixture(scope="module")
def codec():
    from pathlib import Path

    return bpe.codec(Path(bpe.VOCABULARY).read_bytes())


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=120), st.integers(1, 9))
def test_tree_is_the_library(text, leaf):
    from pathlib import Path

    codec = bpe.codec(Path(bpe.VOCABULARY).read_bytes())
    tokens = codec.encode(text, leaf)
    assert tokens == codec.leaf(text)
    assert codec.decode(tokens) == text.encode()


def test_join_is_associative(codec):
    rng = random.Random(1)
    for _ in range(200):
        parts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 30))) for _ in range(3)]
        a, b, c = map(codec.leaf, parts)
        assert codec.join(codec.join(a, b), c) == codec.join(a, codec.join(b, c)) == codec.leaf("".join(parts))


def test_text_without_stable_places(codec):
    text = "é" * 5000 + " " * 3000 + "x" * 5000
    assert codec.encode(text, 64) == codec.leaf(text)


def test_bpe_matches_another_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    made = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    made.encode_special_tokens = True
    rng = random.Random(2)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 400))) for _ in range(60)] + ["<|endoftext|>"]
    out = bpe.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in out:
        assert r.exact and r.tokens == made.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.tokens)


def naive_differencing(sizes, k):
    """Differencing with explicit sets."""
    heap = []
    for s in sorted(sizes, reverse=True):
        part = [[s]] + [[] for _ in range(k - 1)]
        heapq.heappush(heap, (-s if k > 1 else 0, len(heap), part))
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        part = sorted((x + y for x, y in zip(a, reversed(b), strict=True)), key=sum, reverse=True)
        heapq.heappush(heap, (-(sum(part[0]) - sum(part[-1])), n, part))
        n += 1
    return sorted(map(sum, heap[0][2]))


def test_differencing():
    rng = np.random.default_rng(3)
    for n, k in [(1, 3), (7, 3), (40, 4), (200, 7), (5, 1)]:
        sizes = rng.integers(1, 1 << 40, n)
        shard, sums = sharding.balance(sizes, k)
        assert np.array_equal(np.bincount(shard, sizes, k).astype(np.int64), sums)
        assert sorted(sums.tolist()) == naive_differencing(sizes.tolist(), k)
    many = rng.lognormal(8, 1.2, 5000).astype(np.int64)
    _, sums = sharding.balance(many, 16)
    greedy = np.zeros(16, np.int64)
    for s in sorted(many.tolist(), reverse=True):
        greedy[greedy.argmin()] += s
    assert np.ptp(sums) <= np.ptp(greedy)


def test_shards(spark):
    rng = random.Random(4)
    texts = ["x" * int(rng.lognormvariate(5, 1)) + str(i % 300) for i in range(900)]
    out = sharding.assign(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, cell_groups=40).collect()
    total, place = [0] * 5, {}
    for r in out:
        total[r.shard] += r.n_bytes
        assert place.setdefault(texts[r.doc_id], r.shard) == r.shard
    assert len(out) == 900 and max(total) - min(total) <= max(map(len, texts))


def naive_clean(text, items):
    """Word flags by comparing every window of every item."""
    word = lambda t: [t[a:b].lower() for a, b in zip(*spans(t), strict=True)]
    doc, flags = word(text), [False] * len(word(text))
    for item in map(word, items):
        k = min(decontaminate.MAX_WORDS, max(decontaminate.LEAST_WORDS, -(-len(item) * 8 // 10)))
        windows = {tuple(item[i : i + k]) for i in range(len(item) - k + 1)}
        for i in range(len(doc) - k + 1):
            if tuple(doc[i : i + k]) in windows:
                flags[i : i + k] = [True] * k
    return flags


def spans(text):
    w = tk.words(pa.array([text]), lower=False)
    raw = text.encode()
    return [len(raw[:a].decode()) for a in w.starts], [len(raw[:a].decode()) for a in w.ends]


def test_decontamination(spark):
    rng = random.Random(6)
    items = [" ".join(rng.choices("abcde", k=rng.randint(0, 25))) for _ in range(12)]
    texts = []
    for _ in range(60):
        words = rng.choices("abcde", k=rng.randint(0, 30)) + rng.choice(items).split()[rng.randint(0, 4) :] + rng.choices("abcdeX", k=rng.randint(0, 30))
        texts.append(", ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    parts = decontaminate.matchers(spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    many = decontaminate.matchers(spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), part_words=30)
    out = {r.doc_id: r for r in decontaminate.report(docs, parts).collect()}
    again = {r.doc_id: r for r in decontaminate.report(docs, many).collect()}
    assert len(many) > 1 and out == again
    for d, t in enumerate(texts):
        flags = naive_clean(t, items)
        assert (out[d].removed_words if d in out else 0) == sum(flags)
        if d in out:
            left = [w for w, f in zip(t.split(", "), flags, strict=True) if not f]
            assert [w for w in out[d].clean_text.replace(",", " ").split()] == left
            assert out[d].dropped == (sum(flags) > 0.5 * len(flags))


def test_automaton_lengths():
    rng = random.Random(7)
    items = [rng.choices(range(4), k=rng.randint(1, 12)) for _ in range(6)]
    doc = rng.choices(range(5), k=200)
    found = [n for n, _ in decontaminate.Automaton(items, [99] * 6).matches(doc)]
    inside = {tuple(i[a:b]) for i in items for a in range(len(i)) for b in range(a + 1, len(i) + 1)}
    assert found == [max((n for n in range(1, 13) if tuple(doc[e + 1 - n : e + 1]) in inside and n <= e + 1), default=0) for e in range(len(doc))]


def test_shards_with_a_hot_text(spark):
    rng = random.Random(9)
    texts = [f"{i} " + "x" * int(rng.lognormvariate(4, 1)) for i in range(3200)]
    texts += ["hot " * 10] * (sum(map(len, texts)) // 18 // 40)  # nearly a shard's mean
    out = sharding.assign(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 16, cell_groups=400).collect()
    total, place = [0] * 16, {}
    for r in out:
        total[r.shard] += r.n_bytes
        assert place.setdefault(texts[r.doc_id], r.shard) == r.shard
    assert len(out) == len(texts) and max(total) - min(total) <= 0.01 * sum(total) / 16
