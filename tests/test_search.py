import random

import pytest
from pyspark.sql import functions as F

from siftline.functions import analysis, highlight
from siftline.operators.database import SearchDatabase
from siftline.plans.tree import And, Keywords, Or, Phrase
from siftline.sources import index as tables
from siftline.streaming.batches import index_stream, load_batches

TEXTS = ["Running dogs run", "the quick, brown fox\nbrown quick", "a a a\nb a b a b a b", "foo\nbar", "x y z", "a c\nb", "été chaud\n\nlast", "", None]


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    rows = [(i, t, "en" if i % 2 else "fr", i) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string, year int")
    made = SearchDatabase.builder(spark).add_documents(docs, metadata=["lang", "year"], data=["year"]).sentence_metadata(lambda t: F.struct(F.length(t).alias("n")))
    return made.build(str(tmp_path_factory.mktemp("index") / "i"))


def found(db, query, plan="index", **kw):
    node = db.parse_query(query, strict=True) if isinstance(query, str) else query
    return sorted((r.doc_id, r.sentence_idx, [(h.start, h.end) for h in r.highlights]) for r in db.query(node, plan, **kw).collect())


CASES = [
    ("run", [(0, 0, [(0, 7), (13, 16)])]),
    ("quick brown", [(1, 0, [(4, 16)])]),
    ('"a a"', [(2, 0, [(0, 3)])]),
    ("b a b", [(2, 1, [(0, 5), (8, 13)])]),
    ("foo bar", []),
    ("foo AND bar", []),
    ('"x y" AND "y z"', [(4, 0, [(0, 5)])]),
    ("(a AND b) OR c", [(2, 1, [(i, i + 1) for i in range(0, 13, 2)]), (5, 0, [(2, 3)])]),
    ("a OR b OR c", [(2, 0, [(0, 1), (2, 3), (4, 5)]), (2, 1, [(i, i + 1) for i in range(0, 13, 2)]), (5, 0, [(0, 1), (2, 3)]), (5, 1, [(0, 1)])]),
    ("chaud", [(6, 0, [(6, 11)])]),
    ("last", [(6, 2, [(0, 4)])]),
    ("unknownword", []),
    ('"!!!"', []),
    ('foo AND "!!!"', []),
    ('foo OR "!!!"', [(3, 0, [(0, 3)])]),
]


@pytest.mark.parametrize(("query", "want"), CASES)
@pytest.mark.parametrize("plan", ["index", "scan"])
def test_semantics(db, query, want, plan):
    assert found(db, query, plan) == want


def test_filters_lookups_and_parts(db):
    assert found(db, db.parse_query("a OR foo", document_filter="lang = 'en'")) == found(db, db.parse_query("a OR foo").filter_documents(F.col("lang") == "en"), "scan")
    assert [r[:2] for r in found(db, Phrase("foo").filter_documents("year > 9") | Phrase("x"))] == [(4, 0)]
    assert [r[:2] for r in found(db, (Phrase("foo") & Phrase("foo").filter_documents("year = 3")))] == [(3, 0)]
    assert [r[:2] for r in found(db, Phrase("a").filter_sentences("metadata.n > 5"))] == [(2, 1)]
    with pytest.raises(ValueError):
        db.query(Or(Phrase("a").filter_sentences("true"), Phrase("b"))).collect()
    assert db.parse_query("(") is None
    assert [r.data.year for r in db.get_doc(8).collect()] == [8]
    assert db.get_doc(99).count() == 0
    assert (db.term("Dogs"), db.term("cats"), db.tokenize_phrase("!! Dogs run")) == ("dog", None, ["dog", "run"])
    row = db.query(db.parse_query("quick brown"), parts=True, ordered=True).collect()[0]
    assert [(p.highlight, p.text) for p in row.parts] == [(False, "the "), (True, "quick, brown"), (False, " fox")]
    assert {r.df for r in db.index.vocabulary.where("stem = 'a'").collect()} == {3}
    ids = {r.stem: r.term_id for r in __import__("siftline.sources.index", fromlist=["x"]).numbered(db.index.postings).collect()}
    assert sorted(ids.values()) == list(range(1, len(ids) + 1)) and (ids["run"], ids["dog"], ids["the"]) == (1, 2, 3)


def test_postings_are_pruned(db):
    plan = db.query(db.parse_query("foo"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [EqualTo(stem,foo)" in plan or "PushedFilters: [In(stem" in plan or "EqualTo(stem,foo)" in plan


def test_builder_errors(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b c")], "id long, text string")
    with pytest.raises(ValueError):
        SearchDatabase.builder(spark).add_documents(docs).build()
    with pytest.raises(ValueError):
        SearchDatabase.builder(spark).build()
    one, two = docs.where("text = 'a'"), docs.where("text <> 'a'")
    db = SearchDatabase.builder(spark).add_documents(one).add_documents(two).build(on_duplicate="last")
    assert [r.text for r in db.index.sentences.collect()] == ["b c"]
    empty = SearchDatabase.builder(spark).add_documents(docs.where("false")).build()
    assert found(empty, Phrase("a"), "scan") == []


def naive(node, stems):
    """Whether the node matches, and the token ranges it highlights."""
    if isinstance(node, Phrase):
        k, i, out = len(node.terms), 0, []
        while k and i + k <= len(stems):
            if tuple(stems[i : i + k]) == node.terms:
                out.append((i, i + k))
                i += k
            else:
                i += 1
        return bool(out), out
    if isinstance(node, Keywords):
        out = [(i, i + 1) for i, s in enumerate(stems) if s in node.terms]
        return bool(out), out
    parts = [naive(n, stems) for n in node.nodes]
    ok = (all if isinstance(node, And) else any)(p[0] for p in parts)
    return ok, [s for p in parts for s in p[1]] if ok else []


def test_plans_agree_with_naive(spark, tmp_path):
    rng = random.Random(5)
    texts = ["\n".join(" ".join(rng.choices("abcd", k=rng.randint(0, 9))) for _ in range(rng.randint(0, 4))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    db = SearchDatabase.builder(spark).add_documents(docs).build(str(tmp_path / "i"))

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return (Phrase if rng.random() < 0.7 else Keywords)(*rng.choices("abcde", k=rng.randint(0, 3)))
        return rng.choice([And, Or])(*[tree(depth - 1) for _ in range(rng.randint(1, 3))])

    for _ in range(8):
        node = tree(2)
        want = []
        for d, t in enumerate(texts):
            for i, line in enumerate(analysis.lines(t)):
                spans, stems = analysis.tokens(line)
                ok, ranges = naive(node, stems)
                if ok:
                    merged = []
                    for a, b in sorted((spans[a][0], spans[b - 1][1]) for a, b in ranges):
                        if merged and merged[-1][1] > a:
                            merged[-1] = (merged[-1][0], max(merged[-1][1], b))
                        else:
                            merged.append((a, b))
                    want.append((d, i, merged))
        assert found(db, node) == want, node
        assert found(db, node, "scan", optimize=False) == want, node
    rows = db.query(Or(Phrase("a", "b"), Phrase("b", "c")), parts=True).withColumn("m", highlight.marked("parts", "<", ">")).collect()
    assert rows and all("".join(p.text for p in r.parts) == r.text and r.m.replace("<", "").replace(">", "") == r.text for r in rows)


def test_stream_of_batches(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame([(i, f"foo bar {i}")], "id long, text string").write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    index_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    db = load_batches(spark, str(tmp_path / "out"))
    assert [r[0] for r in found(db, "foo bar")] == [0, 1]


def test_ids_alone_read_no_text(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox\nblue fox"), (2, "red hen")], "id long, text string")
    db = SearchDatabase.builder(spark).add_documents(docs).build(str(tmp_path / "ids"))
    found = db.query(db.parse_query("red AND fox"), ids=True)
    assert [tuple(r) for r in found.collect()] == [(1, 0)] and found.columns == ["doc_id", "sentence_idx"]
    assert "/sentences" not in found._jdf.queryExecution().toString()


def test_clashing_names_and_ids(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", 7)], "id long, text string, doc_id long")
    with pytest.raises(ValueError, match="doc_id"):
        SearchDatabase.builder(spark).add_documents(docs, metadata=["doc_id"])
    both = spark.createDataFrame([(1, "a"), (1, "b")], "id long, text string")
    db = SearchDatabase.builder(spark).add_documents(both).build(on_duplicate="last")
    assert [r.text for r in db.query(db.parse_query("a OR b")).collect()] == ["b"]
    for n in (0, 1):
        SearchDatabase.builder(spark).add_documents(docs).build(str(tmp_path / "out" / f"batch-{n:08d}"))
    with pytest.raises(ValueError, match="two batches"):
        load_batches(spark, str(tmp_path / "out"))


def test_postings_are_made_without_a_shuffle(spark, tmp_path):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, "\n".join(" ".join(rng.choices("abé x7", k=rng.randint(0, 30))) for _ in range(3))) for i in range(-5, 40)], "doc_id long, text string")
    found = tables.sentences(docs.repartition(3))
    each = found.select("doc_id", "sentence_idx", F.posexplode("stems").alias("pos", "stem"))
    keys = ["stem", "doc_id", "sentence_idx"]
    want = sorted(tuple(r) for r in each.groupBy(*keys).agg(F.sort_array(F.collect_list("pos")).alias("positions")).collect())
    for words in (1, 50, 1 << 20):
        assert sorted(tuple(r) for r in tables.postings(found, words).collect()) == want
    run = tables.postings(tables.sentences(docs.coalesce(1))).select(*keys)
    assert "Exchange" not in run._jdf.queryExecution().executedPlan().toString()
    one = [tuple(r) for r in run.collect()]
    assert one == sorted(one, key=lambda r: (r[0].encode(), *r[1:]))


def test_first_places_are_hashed_not_sorted(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [("b", high, 2**31 - 1, [2**31 - 2]), ("b", low, 7, [9]), ("a", low, 7, [3, 4]), ("c", high, 0, [0]), ("d", 0, 1, [5]), ("e", 0, 0, [6])]
    found = tables.numbered(spark.createDataFrame(rows, "stem string, doc_id long, sentence_idx int, positions array<int>"))
    assert {r.stem: r.term_id for r in found.collect()} == {"a": 1, "b": 2, "e": 3, "d": 4, "c": 5}
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_filters_come_before_analysis(spark):
    docs = spark.createDataFrame([(1, "red fox", "en"), (2, "red hen", "fr")], "id long, text string, lang string")
    db = SearchDatabase.builder(spark).add_documents(docs, metadata=["lang"]).build()
    got = db.query(db.parse_query("red", document_filter="lang = 'fr'"))
    assert [tuple(r)[:2] for r in got.collect()] == [(2, 0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.index("MapInArrow") < plan.index("= fr")


def test_ids_that_occur_twice(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox"), (1, "fox red")], "id long, text string")
    db = SearchDatabase.builder(spark).add_documents(docs).build(str(tmp_path / "twice"), on_duplicate="any")
    assert sorted(r.text for r in db.query(db.parse_query("red AND fox")).collect()) == ["fox red", "red fox"]
