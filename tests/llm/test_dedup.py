"""Near-duplicate documents, fuzzy lines and repeated passages against brute force."""

import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from siftline.llm import cluster, edits, line_dedup, setsketch, sparse_suffix
from siftline.llm import textkit as tk

rng = np.random.default_rng(8)
WORDS = ["".join(rng.choice(list("abcdefghiklmnoprstu"), rng.integers(2, 10))) for _ in range(900)]


def _text(n):
    return list(rng.choice(WORDS, n))


def _changed(words, share):
    return [str(rng.choice(WORDS)) if rng.random() < share else w for w in words]


def _groups(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    made = {}
    for i in range(n):
        made.setdefault(find(i), set()).add(i)
    return {frozenset(g) for g in made.values() if len(g) > 1}


def test_sketch_laws():
    w = tk.words(pa.array([" ".join(_text(400)) for _ in range(3)]))
    hashes, at = setsketch.shingles(w)
    k = setsketch.registers(hashes, at)
    both = setsketch.registers(hashes[: at[2]], np.array([0, at[2]]))[0]
    assert (setsketch.merged(k[0], k[1]) == both).all()
    assert (setsketch.registers(np.repeat(hashes[: at[1]], 3), np.array([0, 3 * at[1]]))[0] == k[0]).all()


def test_estimate_and_locality():
    for j in (0.3, 0.7, 0.9):
        n, found, equal = 600, [], []
        for _ in range(40):
            own = int(n * (1 - j) / (1 + j))
            e = rng.integers(1, 1 << 63, n + own, dtype=np.uint64)
            k = setsketch.registers(np.concatenate([e[:n], e[own:]]), np.array([0, n, 2 * n]))
            found.append(setsketch.estimate(k[:1], k[1:], np.array([n]), np.array([n]))[0])
            equal.append((k[0] == k[1]).mean())
        assert np.mean(found) == pytest.approx(j, abs=0.03)
        assert np.mean(equal) == pytest.approx(j, abs=0.04)


def test_near_duplicates(spark):
    texts = []
    for _ in range(25):
        base = _text(int(rng.integers(40, 300)))
        texts += [" ".join(_changed(base, s)) for s in (0, 0, 0.02, 0.04, 0.1)[: rng.integers(1, 6)]]
    texts += ["a b", "a b", "x", ""]
    sets = []
    for t in texts:
        w = tk.words(pa.array([t]))
        sets.append(set(setsketch.shingles(w)[0].tolist()))
    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= setsketch.SIMILARITY * len(sets[a] | sets[b])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in setsketch.report(docs).collect():
        found.setdefault(r.group_doc_id, set()).add(r.doc_id)
        assert r.kept == (r.doc_id == r.group_doc_id)
    true = _groups(len(texts), pairs)
    assert len(true & {frozenset(g) for g in found.values()}) >= 0.9 * len(true)
    assert {d for g in found.values() for d in g} <= {d for g in true for d in g}
    assert setsketch.clean(docs).count() == len(texts) - sum(len(g) - 1 for g in found.values())


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_fuzzy_lines(spark):
    lines = []
    for _ in range(22):
        base = " ".join(_text(int(rng.integers(3, 16))))
        lines += [base, base.upper() + "!"]
        for _ in range(2):
            at = int(rng.integers(len(base)))
            lines.append(base[:at] + "é" + base[at + 1 :])
    order = rng.permutation(len(lines)).tolist()
    texts = ["\n".join(lines[i] for i in order[k : k + 4]) for k in range(0, len(order), 4)]
    every = [(d, n, " ".join(x for x in line.lower().replace("!", "").split())) for d, t in enumerate(texts) for n, line in enumerate(t.split("\n"))]
    pairs = [(i, j) for (i, a), (j, b) in itertools.combinations([(i, e[2]) for i, e in enumerate(every)], 2) if abs(len(a) - len(b)) <= 3 and _distance(a, b) <= int(0.1 * max(len(a), len(b)) + 1e-9)]
    stay = set(range(len(every)))
    for g in _groups(len(every), pairs):
        stay -= g - {min(g)}
    out = {r.doc_id: r for r in line_dedup.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    kept = {(d, line) for d, t in enumerate(texts) for line in (out[d].clean_text if d in out else t).split("\n") if line}
    want = {(every[i][0], texts[every[i][0]].split("\n")[every[i][1]]) for i in stay}
    assert len(kept ^ want) <= 0.05 * len(every)
    for d, r in out.items():
        assert r.removed_lines > 0 and r.dropped == (r.clean_text == "") and r.n_lines == 4, d


def test_edit_distances():
    pairs = [("", ""), ("a", ""), ("ab", "ba")]
    for _ in range(400):
        base = " ".join(_text(int(rng.integers(1, 40)))) + rng.choice(["", " é", " 日本"])
        other = list(base)
        for _ in range(int(rng.integers(0, 2 + len(base) // 8))):
            at = int(rng.integers(len(other) + 1))
            other[at : at + int(rng.integers(2))] = ["é", "x", "日", ""][int(rng.integers(4))]
        pairs.append((base, "".join(other)))
    most = [int(0.1 * max(len(x), len(y)) + 1e-9) for x, y in pairs]
    got = edits.within(pa.array([x for x, _ in pairs]), pa.array([y for _, y in pairs]), np.array(most))
    true = [_distance(x, y) <= k for (x, y), k in zip(pairs, most, strict=True)]
    assert got.tolist() == true
    alike = edits.alike(pa.array([x for x, _ in pairs]), pa.array([y for _, y in pairs]), np.array(most))
    assert alike[true].all() and not alike.all()


@pytest.mark.parametrize("few", [0, 1 << 30])
def test_edits_on_the_outermost_diagonals(monkeypatch, few):
    """Texts that are moved by as much as the edits allow, compared together and by themselves."""
    monkeypatch.setattr(edits, "FEW", few)
    pairs = []
    for _ in range(300):
        base = "".join(rng.choice(list("abcd"), int(rng.integers(20, 200))))
        moved = int(rng.integers(1, 40)) % len(base)
        more = "".join(rng.choice(list("efgh"), moved + int(rng.integers(0, 3))))
        pairs.append((more + base[: len(base) - moved], base))
    true = [_distance(x, y) for x, y in pairs]
    for less in (0, 1):
        got = edits.within(pa.array([x for x, _ in pairs]), pa.array([y for _, y in pairs]), np.array(true) - less)
        assert got.tolist() == [less == 0] * len(pairs)


def test_what_both_texts_share_at_their_ends_is_not_compared(monkeypatch):
    """Of 600 characters 200 differ, and 60 edits take one word of 64 diagonals a column."""
    calls = []
    invert = np.invert
    monkeypatch.setattr(edits.np, "invert", lambda *a, **k: calls.append(1) or invert(*a, **k))
    ends = "".join(rng.choice(list("abcdefgh "), 400))
    inner = ["".join(rng.choice(list("abcdefgh "), 200)) for _ in range(100)]
    other = [x[:50] + "é" * 61 + x[111:] if k % 2 else x[:50] + "é" * 59 + x[109:] for k, x in enumerate(inner)]
    inner, other = ([f"{ends[:200]}<{x}>{ends[200:]}" for x in v] for v in (inner, other))
    inner, other = ([x.replace("<", a).replace(">", b) for x in v] for v, a, b in ((inner, "m", "n"), (other, "k", "n")))
    most = np.full(100, 60)
    assert edits.within(pa.array(inner), pa.array(other), most).tolist() == [True, False] * 50
    assert len(calls) <= 2 * 202


def test_trigrams_of_many_texts_take_little_memory():
    """A batch of long pairs isn't taken apart at once."""
    texts = ["".join(random.Random(k).choices("abcdefgh ", k=2000)) for k in range(3000)]
    left, right = pa.array(texts), pa.array(texts[:1500] + texts[:1500])
    tracemalloc.start()
    found = edits.alike(left, right, np.full(3000, 100))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[:1500].all() and not found[1500:].any()
    assert peak < 64 << 20, peak


def test_sketches_tell_no_similar_texts_apart():
    texts = []
    for _ in range(300):
        base = " ".join(_text(int(rng.integers(1, 90)))) + rng.choice(["", " é", " 日本"])
        other = list(base)
        for _ in range(int(rng.integers(0, 2 + len(base) // 10))):
            at = int(rng.integers(len(other) + 1))
            other[at : at + int(rng.integers(2))] = ["é", "x", "日", ""][int(rng.integers(4))]
        texts += [base, "".join(other)]
    texts += ["", "", "a" * 300, "a" * 44, "a" * 300, "a" * 300]
    i, j = np.arange(0, len(texts), 2), np.arange(1, len(texts), 2)
    rows = edits.sketch_rows(edits.sketches(pa.array(texts)))
    most = edits.limits(*(np.array([len(texts[x]) for x in k]) for k in (i, j)), 0.9)
    true = edits.within(pa.array(texts[::2]), pa.array(texts[1::2]), most)
    far = edits.far(rows, i, j, 0.9)
    assert true.sum() > 100 and not (far & true).any() and far[-2]
    assert edits.far(rows, i[:300], np.roll(j[:300], 1), 0.9).mean() > 0.9
    assert len(edits.sketches(pa.array([], pa.string()))) == 0


def test_lines_of_other_characters_are_not_compared(spark, monkeypatch):
    """Lines that share a piece meet, but no text is fetched for pairs that their characters tell apart."""
    made = ["".join(rng.choice(list("abcdefghiklm" if k % 2 else "nopqrstuvwxyz"), 60)) for k in range(40)]
    lines = [f"sharedpieces here {m[:30]} {m[30:]}" for m in made]
    texts = [x for line in lines for x in (line, line[:-1] + "9")] + ["sharedpieces here of one"] * 2
    seen, before = [], line_dedup._similar

    def similar(pairs, texts, similarity):
        seen.append(pairs.count())
        return before(pairs, texts, similarity)

    monkeypatch.setattr(line_dedup, "_similar", similar)
    out = {r.doc_id for r in line_dedup.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out == set(range(1, 82, 2))
    assert sum(seen) < 500, seen


def test_lines_are_fetched_once(spark):
    texts = ["one two three\nfour five", "One two, three!", "é日本 x"]
    docs = spark.createDataFrame([(k % 3, texts[k % 3]) for k in range(9)], "doc_id long, text string")
    w = tk.words(pa.array(["one two three", "four five", "é日本 x"]))
    h = line_dedup.sequence_hashes(w.hashes, w.at).view(np.int64).tolist()
    rid = {r.doc_id: r._rid for r in cluster.row_id(docs).collect()}
    spots = spark.createDataFrame([(h[0], rid[0], 0), (h[1], rid[0], 1), (h[2], rid[2], 0)], "h long, rid long, part int")
    found = sorted((r.h, r.norm) for r in line_dedup._fetched(docs, spots)[0].collect())
    assert found == sorted(zip(h, ["one two three", "four five", "é日本 x"], strict=True))


@pytest.mark.parametrize("most", [100, 1 << 16])
def test_places_of_lost_lines_are_told_exactly(spark, monkeypatch, most):
    monkeypatch.setattr(cluster, "FILTER_BITS", 1 << 16)  # so small that others pass by chance
    made = np.random.default_rng(3)
    rid, line, n = made.integers(-(1 << 63), 1 << 63, 20000).repeat(4), np.tile(np.arange(4), 20000), 80000
    goes, later = made.random(n) < 0.3, made.random(n) < 0.5
    lost = pa.table({"rid": rid[goes], "line": line[goes].astype(np.int32), "first": ~later[goes]})
    first = pa.table({"rid": rid[~(goes & later)], "line": line[~(goes & later)].astype(np.int32)})
    told = [t.value for t in line_dedup._told(cluster.written(spark.createDataFrame(lost)), spark.createDataFrame(first), most)]
    assert np.array_equal(line_dedup._going(told, rid, line), goes)
    assert len(told[-1][0]) <= most and (most > 100 or len(told) > 3)


def test_no_text_is_shuffled_to_take_lines_away(spark):
    texts = [f"{' '.join(_text(12))}\n\n{' '.join(_text(12))}" for _ in range(50)]
    docs = cluster.written(spark.createDataFrame(list(enumerate(texts + texts)), "doc_id long, text string"))
    for made in (line_dedup.clean(docs), line_dedup.report(docs)):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        assert made.count() == 50


def test_connected(spark):
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 440)] + [(None, 3), (7, 7)]
    out = {r.node: r.root for r in cluster.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    true = _groups(500, [(a, b) for a, b in edges if a is not None])
    assert out == {i: min(g) for g in true for i in g}


def test_repeated_passages(spark):
    passages = [_text(int(n)) for n in (50, 51, 60, 90, 200)]
    texts = [[w for piece in (_text(int(rng.integers(0, 80))), passages[int(rng.integers(5))], _text(int(rng.integers(0, 80)))) for w in piece] for _ in range(30)]
    texts += [_text(200) for _ in range(10)] + [_text(49)] * 2 + [["and"] * 120, ["so"] + ["and"] * 70]
    n, seen = sparse_suffix.WORDS, {}
    for d, t in enumerate(texts):
        for i in range(len(t) - n + 1):
            seen.setdefault(tuple(t[i : i + n]), []).append((d, i))
    true, copies = {}, {}
    for places in seen.values():
        for d, i in places if len(places) > 1 else []:
            true.setdefault(d, set()).update(range(i, i + n))
            if (d, i) != min(places):
                copies.setdefault(d, set()).update(range(i, i + n))
    out = {r.doc_id: r for r in sparse_suffix.report(spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")).collect()}
    got = {d: {x for s in r.spans for x in range(s.start, s.end)} for d, r in out.items()}
    assert set(got) == set(true)
    assert all(got[d] <= true[d] for d in got)
    assert sum(map(len, got.values())) >= 0.97 * sum(map(len, true.values()))
    lost, want = sum(r.copied_words for r in out.values()), sum(map(len, copies.values()))
    assert 0.9 * want <= lost <= 1.02 * want


def _misspelt(line, share):
    letters = list(line)
    at = rng.choice([i for i, c in enumerate(letters) if c != " "], int(share * len(line)), replace=False)
    for i in at:
        letters[i] = "abcdefghiklmnoprstu"[(("abcdefghiklmnoprstu".index(letters[i])) + 1 + int(rng.integers(18))) % 19]
    return "".join(letters)


@pytest.mark.parametrize(("words", "share", "least"), [(12, 0.04, 0.97), (25, 0.06, 0.97), (50, 0.04, 0.99), (50, 0.08, 0.95), (100, 0.08, 0.95), (300, 0.08, 0.95), (300, 0.095, 0.9)])
def test_edited_lines_meet(words, share, least):
    lines = [" ".join(_text(words)) for _ in range(200)]
    found = []
    for texts in (lines, [_misspelt(x, share) for x in lines]):
        w = tk.words(pa.array(texts))
        line, key, _, _, many = line_dedup.keys_of(w.hashes, w.ends - w.starts, w.at, w.starts - np.repeat(w.row_at[:-1], np.diff(w.at)))
        found.append((set(zip(line.tolist(), key.tolist(), strict=True)), many))
    shared = np.bincount([i for i, _ in found[0][0] & found[1][0]], minlength=len(lines))
    assert (shared >= 1 + (found[0][1] & found[1][1])).sum() >= least * len(lines)


def test_edited_long_lines(spark):
    lines = [" ".join(_text(int(n))) for n in rng.integers(30, 200, 40)]
    texts = [x for line in lines for x in (line, _misspelt(line, 0.07))]
    out = {r.doc_id for r in line_dedup.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out <= set(range(1, 80, 2)) and len(out) >= 38


def test_edited_lines_of_few_words(spark):
    def spoilt(line, edits):
        for at in np.linspace(0, len(line) - 1, edits + 2)[1:-1].round().astype(int).tolist():
            line = line[:at] + "q" + line[at + 1 :]
        return line

    words = lambda *sizes: " ".join("".join(rng.choice(list("abcdefghiklmnoprstu"), n)) for n in sizes)
    chinese = lambda n: "".join(chr(int(c)) for c in rng.integers(0x4E00, 0x9000, n))
    lines = [words(n) for n in range(10, 40)] + [words(3, n) for n in range(7, 30)] + [words(4, 3, n) for n in range(5, 30)] + [chinese(n) for n in range(10, 60)] + [chinese(500), words(900)]
    texts = [x for line in lines for x in (line, spoilt(line, len(line) // 10))]
    texts += ["kleinigkeiten", "kleinigkeitn"]
    out = {r.doc_id for r in line_dedup.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out == set(range(1, len(texts), 2))


def test_repeats_of_edited_copies(spark):
    texts = [_changed(base, 0.06) for base in (_text(300) for _ in range(3)) for _ in range(120)]
    n, seen, true = sparse_suffix.WORDS, {}, {}
    for d, t in enumerate(texts):
        for i in range(len(t) - n + 1):
            seen.setdefault(tuple(t[i : i + n]), []).append((d, i))
    for places in seen.values():
        for d, i in places if len(places) > 1 else []:
            true.setdefault(d, set()).update(range(i, i + n))
    out = {r.doc_id: {x for s in r.spans for x in range(s.start, s.end)} for r in sparse_suffix.report(spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert all(out[d] <= true.get(d, set()) for d in out)
    share = sum(map(len, out.values())) / sum(map(len, true.values()))
    print("\nrecall", share, len(out) / len(true))
    assert share >= 0.95


def test_lines_of_one_dense_key_take_little_memory():
    rng = np.random.default_rng(3)
    n = 4000
    lines = pa.array(["".join(rng.choice(list("abcdefgh"), 40)) for _ in range(n)])
    packed = np.full(n, round(np.log(40) * line_dedup.LOG)) | (1 << 32)
    ids, root = np.arange(n) + 7, np.arange(n) // 2
    t = pa.table({"x": np.ones(n, np.int64), "y": ids, "z": packed, "n": np.zeros(n, np.int64), "sketch": edits.sketches(lines), "root": root})
    tracemalloc.start()
    got = line_dedup._across_keys(t, 0.9, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # 16 million pairs of two numbers are 256 MB
    rows = edits.sketch_rows(t.column("sketch").chunk(0))
    i, j = np.triu_indices(n, 1)
    i, j = (v[root[i] != root[j]] for v in (i, j))
    near = ~edits.far(rows, i, j, 0.9)
    assert sorted(zip(*(got.column(c).to_pylist() for c in "ab"), strict=True)) == list(zip((i[near] + 7).tolist(), (j[near] + 7).tolist(), strict=True))


def test_keys_meet_slice_by_slice_as_at_once():
    rng = np.random.default_rng(4)
    key = np.sort(rng.integers(0, 60, 3000).astype(np.uint64))
    code = rng.integers(3000, 3400, len(key))
    order = np.lexsort((code, key))
    key, code, ids = key[order], code[order], rng.permutation(len(key)).astype(np.uint64)
    p, q = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    many = np.zeros(len(key), np.uint16)
    i, j, more, dense = line_dedup._met(key, ids, code, p, q, many, 0.9, 4)
    want = sorted(zip(i.tolist(), j.tolist(), strict=True))
    assert len(set(want)) == len(want)  # a pair that is there twice would count as two shared keys
    for size in (1, 100, 10_000):
        got, flags, end = [], [], 0
        for own in line_dedup._slices(key, size):
            assert own.start == end and own.stop > own.start
            end = own.stop
            a, b, m, d = line_dedup._met(*(v[own] for v in (key, ids, code, p, q, many)), 0.9, 4)
            got += zip((a + own.start).tolist(), (b + own.start).tolist(), strict=True)
            flags.append((m, d))
        assert end == len(key) and sorted(got) == want
        assert (np.concatenate([f[0] for f in flags]) == more).all() and (np.concatenate([f[1] for f in flags]) == dense).all()
    assert list(line_dedup._slices(key[:0], 5)) == []
