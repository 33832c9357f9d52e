"""Registered scores of the classifiers against plain versions: the same fitted model, every text's features by hand."""

import math
import re

import numpy as np
import pyarrow.parquet as pq

from tidemark.llm import quality, registry, toxicity, words

SF = "/root/testdata/sf0.001"


def fitted(spark, fit):
    return fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def texts():
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return {r["doc_id"]: (r["text"] or "").encode() for r in rows}


def low(b):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), b)


def test_toxicity_scores(spark):
    model = fitted(spark, toxicity.fit_toxicity)
    weight = dict(zip(model.keys.tolist(), model.weights.tolist()))
    got = {r.doc_id: r for r in registry.queries()["op4_toxicity"](spark, SF).collect()}
    known = {}
    for k, b in texts().items():
        own = set()
        for w in set(re.findall(rb"[0-9a-z\x80-\xff]+", low(b))):
            if w not in known:
                one = words.words_of(w.decode(), words.ALNUM)
                known[w] = {int(one.key[0]), *(int(x) for n in toxicity.PREFIXES if len(w) > n for x in one.prefixes(n)[1])}
            own |= known[w]
        z = model.bias + sum(weight.get(f, 0.0) for f in own)
        assert abs(got[k].score - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9 and got[k].predicted == int(got[k].score >= 0.5)


def plain_features(b):
    ws, size = re.findall(rb"[^\x20\x09-\x0D]+", low(b)), max(1, len(b))
    n = max(1, len(ws))
    of = lambda chars: sum(c in chars for c in b)
    upper, lower = sum(65 <= c <= 90 for c in b), sum(97 <= c <= 122 for c in b)
    shares = [upper / max(1, upper + lower), of(b"0123456789") / size, *(of(m) / size for m in quality.MARKS)]
    shares += [sum(x == y for x, y in zip(ws, ws[1:])) / n, (len(ws) - len(set(ws))) / n]
    shares += [sum(not (97 <= w[-1] <= 122 or w[-1] >= 128) for w in ws) / n, sum(len(w) == 1 for w in ws) / n]
    return [*shares, *map(math.sqrt, shares), sum(map(len, ws)) / n / 10, math.log1p(len(ws)) / 10, float(not ws)]


def test_quality_scores(spark):
    model = fitted(spark, quality.fit_quality)
    got = {r.doc_id: r for r in registry.queries()["op6_quality"](spark, SF).collect()}
    for k, b in texts().items():
        u = sum(w * (x - m) / s for w, x, m, s in zip(model.weights, plain_features(b), model.mean, model.scale))
        assert abs(got[k].score - 1 / (1 + math.exp(-max(-30, min(30, u - model.cut))))) < 1e-9 and got[k].predicted == int(got[k].score >= 0.5)
    assert np.isfinite(model.weights).all()
