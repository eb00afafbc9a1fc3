"""Trained operators: held-out accuracy and what each method promises."""

import numpy as np
import pyarrow as pa
import pytest

from siftline.llm import licenses, quality_gam, risk_rules, toxicity
from siftline.llm import textkit as tk

rng = np.random.default_rng(4)


def _text(words, n=12):
    return " ".join(rng.choice(words, n))


NEUTRAL = [f"w{i}" for i in range(300)]
BAD = ["vile", "scummy", "rotten"]


def _toxic(n, term=None, share=0.0, told=1.0):
    texts, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        words = _text(NEUTRAL).split() + ([str(rng.choice(BAD))] if toxic and rng.random() < told else [])
        if term and rng.random() < (share if toxic else share / 8):
            words.append(term)
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, labels


def test_toxicity_held_out():
    model = toxicity.fit(*_toxic(900))
    texts, labels = _toxic(300)
    found = model.scores(pa.array(texts)) >= toxicity.CUTOFF
    assert (found == np.array(labels, bool)).mean() > 0.98


def test_counterfactuals_reduce_false_positives():
    texts, labels = _toxic(900, "muslim", 0.9, 0.6)
    neutral = pa.array([_text(NEUTRAL) + " muslim" for _ in range(200)])
    free, held = (toxicity.fit(texts, labels, fairness=f) for f in (0.0, 10.0))
    assert held.scores(neutral).mean() < 0.5 * free.scores(neutral).mean()
    test, truth = _toxic(300)
    assert ((held.scores(pa.array(test)) >= 0.5) == np.array(truth, bool)).mean() > 0.95


def test_copies_teach_once():
    text = "this is a text of eight words or more"
    texts = [text] * 50 + [f"{text} {i}" for i in range(3)] + ["another text that has nothing in common"]
    assert len(toxicity._once(toxicity._minima(tk.words(pa.array(texts))), np.ones(len(texts)))) == 2


def test_gam_held_out():
    x = rng.random((4000, len(quality_gam.FEATURES)), np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)  # an interaction alone
    model = quality_gam.fit(x[:3000], y[:3000])
    assert ((model.scores(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9
    assert (0, 1) in {tuple(sorted(p[:2])) for p in model.pairs}
    by_hand = [model.intercept + sum(t[np.searchsorted(e, v, "right")] for e, t, v in zip(model.edges, model.tables, row, strict=True)) + sum(t[np.searchsorted(a, row[i], "right"), np.searchsorted(b, row[j], "right")] for i, j, a, b, t in model.pairs) for row in x[:5]]
    assert np.allclose(model.logits(x[:5]), by_hand)


def test_binomial_tail():
    from math import comb

    for n, k, p in [(10, 0, 0.1), (40, 3, 0.2), (7, 7, 0.5), (0, 0, 0.5)]:
        assert risk_rules.binomial_tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    assert risk_rules.tightest(np.array([0, 0, 1, 30]), 500, 0.02, 0.05) == 2
    assert risk_rules.tightest(np.array([0, 0]), 20, 0.02, 0.05) == -1  # too few for a guarantee


def test_rules_keep_their_promise(spark):
    good = [(i, " ".join(f"{w}{j % 7}" for j, w in enumerate(rng.choice(NEUTRAL, rng.integers(20, 60)))), "en") for i in range(1500)]
    bad = [(5000 + i, "### $$$ %%% !!! " * 8 + f"x{i}", "en") for i in range(200)]
    other = [(9000, "### $$$ %%%", "de")]
    docs = spark.createDataFrame(good + bad + other, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(1500)] + [(5000 + i, 0) for i in range(100)], "doc_id long, quality int")
    out = {r.doc_id: r.failed for r in risk_rules.judged(docs, labels).collect()}
    assert sum(bool(out[i]) for i in range(1500)) <= risk_rules.RISK * 1500
    assert all(out[5000 + i] for i in range(200))
    assert out[9000] == []  # no labelled document in its stratum


def test_licences_held_out():
    model = licenses.train()
    texts, y = licenses.statements(99, 60)
    p = model.probabilities(tk.words(pa.array(texts)))
    families = len(licenses.TEMPLATES)
    best = p.argmax(1)
    assert (best == y)[y < families].mean() > 0.95
    assert (best >= families)[y >= families].mean() > 0.97
    sure = p.max(1)
    assert abs(sure.mean() - (best == y).mean()) < 0.05  # calibrated
    assert (model.weights == 0).mean() > 0.3  # sparse


def test_licence_scan(spark):
    lines = ["plain words\nLicensed under the Apache License, Version 2.0.\nmore", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Licensed under the Foobar Public License, version 2.", "All rights reserved.", "his license plate was lost", "This work is licensed under the GNU General Public License, version 3."]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    out = {(r.doc_id, r.line): r.family for r in licenses.scan(docs, licenses.train()).collect()}
    assert out == {(0, 1): "apache-2.0", (1, 0): "mit", (2, 0): "cc-by-nc", (3, 0): "unknown", (4, 0): "proprietary", (6, 0): "gpl-3.0"}


def test_licence_bodies(spark):
    lines = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "This is free and unencumbered software released into the public domain.", "Lizenziert unter der Foobar Lizenz, Version 2", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "Available under several licenses, foo and bar.", "You may sublicense this work under these terms.", "permission to use the hall was granted", "and this or that of the town"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    out = {r.doc_id: r.family for r in licenses.scan(docs, licenses.train()).collect()}
    assert out == {0: "bsd", 1: "unknown", 2: "unknown", 3: "unknown", 4: "mit", 5: "unknown", 6: "unknown"}
