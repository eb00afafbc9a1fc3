"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

from siftline.llm import bpe, decontaminate, licenses, line_dedup, quality_gam, risk_rules, setsketch, sharding, sparse_suffix, toxicity

LONG = " ".join(f"word{i}" for i in range(30_000)) + "\n" + "same line again here\n" * 500
SAME = "one two three four five six seven eight nine ten eleven twelve"
ROWS = [(1, SAME, "en"), (1, SAME, "en"), (2, SAME, None), (None, SAME + " x", "en"), (None, None, None), (3, None, "de"), (4, "", "en"), (5, "\n\n", "en"), (6, LONG, "fr"), (7, "!!! ??", "en"), (8, "ä ö", "de"), (8, "ä ö other", "de")]


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    clash = {c: F.lit(1) for c in ["_rid", "rid", "_lines", "_kept", "h", "key", "tokens", "decoded", "_tokens", "g", "node"]}
    return made.withColumns(clash).withColumn("void", F.lit(None).cast("string"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, 0), (None, 1, 1), (6, None, None), (8, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, SAME), (2, None), (3, ""), (4, "!"), (5, SAME)], "item_id long, text string")


def operators(labels, items):
    return {
        "decontaminate.report": lambda d: decontaminate.report(d, decontaminate.matchers(items)),
        "decontaminate.clean": lambda d: decontaminate.clean(d, decontaminate.matchers(items)),
        "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels)),
        "risk_rules": lambda d: risk_rules.judged(d, labels),
        "setsketch.report": setsketch.report,
        "setsketch.clean": setsketch.clean,
        "line_dedup.report": line_dedup.report,
        "line_dedup.clean": line_dedup.clean,
        "sharding": lambda d: sharding.assign(d, 3, cell_groups=4),
        "sharding by column": lambda d: sharding.assign(d, 3, F.col("lang")),
        "bpe.report": bpe.report,
        "bpe": lambda d: bpe.decode(bpe.encode(d), "__tokens"),
        "quality.score": lambda d: quality_gam.score(d, quality_gam.train(d, labels)),
        "quality.keep": lambda d: quality_gam.keep_good(d, quality_gam.train(d, labels)),
        "sparse_suffix": sparse_suffix.report,
        "licenses": lambda d: licenses.scan(d, licenses.train(each=20, rounds=20)),
    }


NAMES = list(operators(None, None))
ROW_FOR_ROW = {"toxicity", "risk_rules", "sharding", "sharding by column", "bpe.report", "bpe", "quality.score"}


@pytest.mark.parametrize("name", NAMES)
def test_odd(docs, labels, items, name):
    out = operators(labels, items)[name](docs).collect()
    if name in ROW_FOR_ROW:
        assert sorted(map(repr, (r.doc_id for r in out))) == sorted(repr(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty(docs, labels, items, name):
    assert operators(labels, items)[name](docs.where("false")).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_nothing_to_learn_from(docs, labels, items, name):
    operators(labels.where("false"), items.where("false"))[name](docs).collect()


def test_results(docs, labels, items):
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=repr)
    gone = decontaminate.report(docs, decontaminate.matchers(items)).where("dropped")
    assert ids(gone) == [1, 1, 2, None]
    assert ids(decontaminate.clean(docs, decontaminate.matchers(items))) == [3, 4, 5, 6, 7, 8, 8, None]
    kept = setsketch.clean(docs)
    assert ids(kept) == [1, 3, 4, 5, 6, 7, 8, 8, None]
    assert kept.columns == docs.columns
    lines = line_dedup.clean(docs)
    assert lines.columns == docs.columns
    assert ids(lines) == [1, 1, 3, 4, 5, 6, 7, 8, 8, None]
    assert [r.text.count("same line") for r in lines.where("doc_id = 6").collect()] == [1]
    found = bpe.decode(bpe.encode(docs), "__tokens")
    assert all(r._decoded == r.text for r in found.collect())
    assert [(r.spans[0].start, r.copied_words > 1900) for r in sparse_suffix.report(docs).collect()] == [(30_000, True)]
