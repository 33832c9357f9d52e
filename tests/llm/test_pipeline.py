"""The stages of the pipeline against plain versions, each on what its predecessor kept."""

import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from test_llm_queries import brute_components, shingles
from tokenizers import Tokenizer

from tidemark.llm.quality import fit_quality, score_quality
from tidemark.plans.lineage import cut

SF = "/root/testdata/sf0.001"


def test_registered():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run and len(corpus_pipeline.STAGES) == 5


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, SF))
        if name != "packing":
            assert docs.columns == before.columns
        kept[name] = (before.collect(), docs.collect())
    old, new = kept["quality"]
    scored = score_quality(spark.read.parquet(f"{SF}/documents.parquet"), fit_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")))
    assert {r.doc_id for r in new} == {r.doc_id for r in scored.filter("score >= 0.5").collect()} and len(new) < len(old)

    old, new = kept["line_dedup"]
    fold = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    count = Counter(k for r in old for k in {fold(x) for x in r.text.split("\n")} if k)
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if count[fold(x)] < 10) for r in old}
    assert {r.doc_id: r.text for r in new} == want and all(r.n_chars == len(r.text) for r in new)

    old, new = kept["ngram_jaccard"]
    label = brute_components({r.doc_id: shingles(r.text, 5) for r in old}, 80, 100)
    assert sorted(r.doc_id for r in new) == sorted(k for k, v in label.items() if k == v)

    old, new = kept["decontaminate"]
    plain = lambda t: " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) + " "
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaky = {r.doc_id for r in old if any(i in plain(r.text) for i in items)}
    assert {r.doc_id for r in new} == {r.doc_id for r in old} - leaky

    old, new = kept["packing"]
    assert {r.doc_id for r in new} == {r.doc_id for r in old}
    assert all(sum(r.length for r in new if r.doc_id == k) == n for k, n in {(r.doc_id, r.doc_tokens) for r in new})


def test_repeated_ids_keep_the_longest_text(spark):
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (1, "short", "en", "s", 5), (None, "x", "en", "s", 1), (None, "x", "en", "s", 1), (2, "", "en", "s", 0), (3, None, "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()), key=repr)
    assert got == sorted([(1, "a b c d e f"), (None, "x"), (None, "x"), (2, ""), (3, None)], key=repr)


def test_a_leak_takes_no_other_row_without_id(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(None, f"x {item} y", "en", "s", 1), (None, "clean", "en", "s", 5), (None, "clean", "en", "s", 5), (None, None, "en", "s", 0), (7, item, "en", "s", 1), (7, "clean", "en", "s", 5), (8, "clean", "en", "s", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.decontaminate(spark, df, SF).collect()]
    assert sorted(got, key=repr) == sorted([(None, "clean"), (None, "clean"), (None, None), (8, "clean")], key=repr)


def test_the_whole_pipeline_on_documents_made_by_hand(spark, tmp_path):
    """What each kind of document comes to, known beforehand: junk, a common line, copies, near copies, leaks and clean texts."""
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("aeioulnrst"), rng.integers(2, 9))) for _ in range(400)]
    prose = lambda n=60: " ".join(rng.choice(words, n)) + "."
    junk = lambda: " ".join("".join(rng.choice(list("#$%&*@!0123456789"), 9)) for _ in range(40))
    item = "which of these seven rivers flows through more countries than any other river in the whole world"
    texts = {i: prose() for i in range(80)} | {i: junk() for i in range(100, 140)}
    lines = {200 + i: f"{prose()}\nRead More About It Here\n{prose(20)}" for i in range(12)}
    copied = prose(80)
    near = copied.replace(copied.split()[40], "changedword", 1)
    texts |= lines | {300: copied, 301: copied, 302: near, 303: prose(80)}
    texts |= {400: f"{prose(30)} {item} {prose(30)}", 401: f"{prose(20)} {item.replace('seven', 'eight').replace('whole', 'wide')} {prose(20)}", 402: f"{prose(30)} which of these seven {prose(30)}"}
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    labelled = [(i, int(i < 100), 0) for i in texts if i < 140 and i % 2]
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labelled, "doc_id long, quality int, toxic int"), ("benchmark", [(1, item)], "item_id long, text string")):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = set(texts) - set(range(100, 140)) - {301, 302, 400, 401}
    assert {r.doc_id for r in got} == want
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == sum(p.length for p in pieces.get(r.doc_id, []))
        pieces.setdefault(r.doc_id, []).append(r)
    for i in want:
        text = "\n".join(x for x in texts[i].split("\n") if x != "Read More About It Here")
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        assert sum(p.length for p in pieces[i]) == pieces[i][0].doc_tokens == len(ids)
        for p in pieces[i]:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024
