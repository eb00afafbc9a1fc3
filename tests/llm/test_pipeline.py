"""The pipeline stage by stage against plain Python, and the queries' registration."""

from pathlib import Path

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from siftline.llm import bpe, decontaminate, line_dedup, quality_gam, queries, setsketch

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DIR).exists(), reason="the tables are elsewhere")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, states = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, states[-1], DIR).write.parquet(str(tmp_path / str(i)))
        states.append(spark.read.parquet(str(tmp_path / str(i))))
    assert all(s.columns == columns for s in states[:-1])
    text = [{r.doc_id: r.text for r in s.select("doc_id", "text").collect()} for s in states[:-1]]
    model = quality_gam.train(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    assert set(text[1]) == {r.doc_id for r in quality_gam.score(docs, model).where("kept").collect()}
    assert all(set(b) <= set(a) for a, b in zip(text, text[1:], strict=False))
    lost = {r.doc_id: r for r in line_dedup.report(states[1]).collect()}
    assert text[2] == {d: lost[d].clean_text if d in lost else t for d, t in text[1].items() if not (d in lost and lost[d].dropped)}
    gone = {r.doc_id for r in setsketch.report(states[2]).where("NOT kept").collect()}
    assert text[3] == {d: t for d, t in text[2].items() if d not in gone}
    found = {r.doc_id: r for r in decontaminate.report(states[3], decontaminate.matchers(spark.read.parquet(f"{DIR}/benchmark.parquet"))).collect()}
    assert text[4] == {d: found[d].clean_text if d in found else t for d, t in text[3].items() if not (d in found and found[d].dropped)}
    codec = bpe.codec(Path(bpe.VOCABULARY).read_bytes())
    last = {r.doc_id: r for r in states[5].collect()}
    assert set(last) == set(text[4]) and all(last[d].tokens == codec.leaf(t) and last[d].exact for d, t in text[4].items())
    whole = {r.doc_id: r.tokens for r in corpus_pipeline.run(spark, DIR).collect()}
    assert whole == {d: r.tokens for d, r in last.items()}


def test_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(names) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not Path(DIR).exists(), reason="the tables are elsewhere")
def test_decontamination_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()["op1_decontaminate"] + " ORDER BY doc_id").fetchall()
    got = queries.op1_decontaminate(spark, DIR).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want and np.all([len(r) == 6 for r in got])
