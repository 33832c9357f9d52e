"""Registered queries against DuckDB or brute force on the smallest tables, and small awkward inputs."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from helpers import duck, spark_rows
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, embeddings, licenses, line_dedup, ngram_join, packing, quality, registry, secrets, toxicity, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


AWKWARD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "a b c"), (5, "a b c"), (None, "x y z w"), (7, "w " * 60_000)]


@pytest.fixture(scope="module")
def awkward(spark):
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string")
    return df.withColumns({"score": F.lit("theirs"), "n_lines": F.lit("theirs"), "hash": F.lit(1), "row": F.lit(2)})


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    got, want = spark_rows(registry.queries()[name](spark, SF)), duck(SF, registry.oracle_sql()[name])
    assert got == want


# ---- words


def test_hashes_are_of_words_not_places():
    w = words.words_of("Ab cD ab\ncd  ÄB äb", words.NOT_SPACE)
    assert [w.text(i) for i in range(6)] == ["ab", "cd", "ab", "cd", "Äb", "äb"]
    assert w.key[0] == w.key[2] and w.key[1] == w.key[3] and len(set(w.key.tolist())) == 4
    _, pos, key = w.grams(2)
    assert pos.tolist() == [0, 1, 2, 3, 4] and key[0] == key[2]


# ---- 1 chat


def test_templates_fold_and_stay_in_the_sandbox():
    assert chat.fold(chat.parse("a{{ 'b' ~ 1 }}{% if 1 == 2 %}x{% else %}c{% endif %}")) == (chat.Emit(chat.Const("ab1c")),)
    for bad in ("{{ m.__class__ }}", "{{ f(1) }}", "{% for %}", "{% if a %}", "{{ a | nothing }}", "{% set a = 1 %}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad)
    t = chat.Template("{% for m in messages %}{% if loop.first %}<{% endif %}{{ m.text | upper }}{% if not loop.last %},{% else %}>{% endif %}{% endfor %}")
    assert "".join(p for p, _ in t.render([{"text": "a"}, {"text": "b"}])) == "<A,B>"


@pytest.mark.parametrize("text", ["", "<|im_end|>\n<|im_start|>user\n", "<\\|", "<\\\\|x<|", "<<||", "a\\nb", "<", "\x00ü"])
def test_escapes_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text + "\n" + text)) == text + "\n" + text
    pieces = [p for p, _ in chat.Template(chat.CHATML).render([{"role": text, "text": text}, {"role": "assistant", "text": text}])]
    assert list(chat.read_turns(pieces)) == [(text, text), ("assistant", text)]


def test_chat_nulls_ties_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string, piece string"
    rows = [(1, 0, "user", None, "x"), (1, 0, "user", None, "x"), (1, None, "assistant", "b", "x"), (None, 0, None, "q", "x")]
    got = {r.conv_id: r for r in chat.digest_formatted(chat.format_conversations(spark.createDataFrame(rows, schema))).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 1 and got[None].n_turns == 1
    assert got[1].turns_sha256 == hashlib.sha256(b"assistant\nb\nuser\n\nuser\n\n").hexdigest()
    assert chat.format_conversations(spark.createDataFrame([], schema)).count() == 0


# ---- 2 n-gram join


def brute_components(sets, num, den):
    parent = {k: k for k in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    keys = sorted(k for k in sets if sets[k])
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x = len(sets[a] & sets[b])
            if den * x >= num * (len(sets[a]) + len(sets[b]) - x) and find(a) != find(b):
                u, v = find(a), find(b)
                parent[max(u, v)] = min(u, v)
    return {k: find(k) for k in sets}


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_ngram_join_on_documents(spark, docs):
    got = {r.doc_id: r for r in registry.queries()["op2_ngram_jaccard_join"](spark, SF).collect()}
    sets = {k: shingles(t, 4) for k, t in docs.items()}
    want = brute_components(sets, 85, 100)
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == {k: (len(sets[k]), want[k]) for k in docs}


def test_ngram_join_chains_groups_and_awkward_rows(spark, awkward):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    texts, other = {}, [f"v{i}" for i in range(80)]
    for i in range(60):  # a chain of slow drift, and near copies around one text
        drift = base[: i // 2] and [f"d{j}" for j in range(i // 2)] + base[i // 2 :]
        texts[i] = " ".join(drift or base)
        copy = list(other)
        copy[rng.integers(80)] = f"e{i % 9}"
        texts[100 + i] = " ".join(copy)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for n, num in ((4, 85), (5, 80), (2, 60)):
        want = brute_components({k: shingles(t, n) for k, t in texts.items()}, num, 100)
        got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(df, n, num, 100).collect()}
        assert got == want
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(awkward, 4, 85, 100).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 5), None: (1, None), 7: (1, 7)}
    assert ngram_join.similar_documents(awkward.limit(0)).count() == 0


# ---- 3 licenses


def test_licenses_on_documents(spark, docs):
    got = {r.doc_id: r for r in registry.queries()["op3_license_scan"](spark, SF).collect()}
    for k, t in docs.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(i, label) for label, p in licenses.BASE_PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None)
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_licenses_edited_and_awkward(spark, awkward):
    mit = licenses.TEMPLATES[0][1].replace("without restriction", "with no restriction at all")
    df = spark.createDataFrame([(1, "x " * 50 + mit), (2, "mit MIT license mit license"), (2, "nothing")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_base, r.labels, r.score > 0.7, [s.start for s in r.spans]) for r in licenses.license_scan(df).collect()), key=repr)
    assert got == [(1, 0, "mit", True, [50]), (2, 0, "", False, []), (2, 2, "mit", True, [1, 3])]
    rows = licenses.license_scan(awkward).collect()
    assert Counter(r.doc_id for r in rows) == Counter(k for k, _ in AWKWARD) and all(r.score == 0 for r in rows)
    assert licenses.license_scan(awkward.limit(0)).count() == 0


# ---- 4 and 6 classifiers


def accuracy(spark, name, target):
    r = registry.queries()[name](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    return r.filter("held_out").agg(F.avg((F.col("predicted") == F.col(target)).cast("int"))).first()[0]


def test_held_out_accuracy(spark):
    assert accuracy(spark, "op4_toxicity", "toxic") > 0.94
    assert accuracy(spark, "op6_quality", "quality") > 0.95


def test_counterfactual_penalty_evens_out_identity_terms():
    # toxic texts name one group more often; the penalty takes that feature's weight away
    rows, cols, y = [], [], []
    for i in range(200):
        toxic = i % 4 == 0
        y.append(float(toxic))
        for c, has in ((0, toxic and i % 8 == 0), (1, toxic or i % 5 == 0), (2, i % 7 == 0)):
            if has:
                rows.append(i), cols.append(c)
    y, rows, cols = np.array(y), np.array(rows), np.array(cols)
    named = rows[cols == 1]
    pairs = np.repeat(np.arange(len(named)), 2), np.tile([1, 2], len(named)), np.tile([1.0, -1.0], len(named))
    free, _ = toxicity.fit(rows, cols, y, 3, *pairs, len(named), 1e-4, 0.0)
    held, _ = toxicity.fit(rows, cols, y, 3, *pairs, len(named), 1e-4, 10.0)
    assert abs(held[1] - held[2]) < 0.3 * abs(free[1] - free[2])


def test_classifiers_take_awkward_rows(spark, awkward):
    for fit, score, target in ((quality.fit_quality, quality.score_quality, "quality"), (toxicity.fit_toxicity, toxicity.score_toxicity, "toxic")):
        labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (7, None, None), (None, 1, 1), (2, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
        for lab in (labels, labels.limit(0), labels.filter(f"{target} = 1")):
            rows = score(awkward, fit(awkward, lab)).collect()
            assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
        assert score(awkward.limit(0), fit(awkward, labels)).count() == 0


# ---- 5 secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(t):
    s = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    s += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    s += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(s))


def test_secrets(spark, docs, awkward):
    texts = dict(list(docs.items())[:100]) | {
        -1: "ü𝄞 Token: 'abcdefgh12' token=ab secret:password: hunter2hunter2", -2: "AKIA" + "Z" * 12 + " AKIAAKIA1 AKIA" + "9" * 40, -3: "deadbeef" * 4 + "x" + "a1" * 20, -4: "api_key=secret=12345678",
        -5: "key a7f3c09be1d24f68b05c9d3e and averyveryverylongordinaryword", -6: "\n".join(f"password={hashlib.md5(str(i).encode()).hexdigest()[:18]}" for i in range(800)),
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    ratios = secrets.train_models(secrets.find_spans(df, "text"))
    assert len(ratios) == secrets.N**2
    for r in secrets.secret_scan(df, ratios).collect():
        said = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.secrets if s.kind != "markov")
        assert said == base_spans(texts[r.doc_id])
        assert [s.start for s in r.secrets] == sorted(s.start for s in r.secrets)
        if r.doc_id == -5:
            assert [texts[-5][s.start : s.end] for s in r.secrets] == ["a7f3c09be1d24f68b05c9d3e"]
    rows = secrets.secret_scan(awkward, secrets.train_models(secrets.find_spans(awkward, "text"))).collect()
    assert len(rows) == len(AWKWARD) and not any(r.secrets for r in rows)
    plan = secrets.secret_scan(df, ratios)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- 7 packing


def test_packing(spark, awkward):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    more = [(9, " two  spaces\tand\n\nlines "), (10, "<|endoftext|> it's x<|endoftext|>y's"), (11, "n\xa0b 12,5 über x"), (12, "nul\x00 a b")]
    df = awkward.select("doc_id", "text", "score").union(spark.createDataFrame(more, "doc_id long, text string").withColumn("score", F.lit("x")))
    rows = packing.pack_documents(df, path).collect()
    t = Tokenizer.from_file(path)
    want = Counter()
    for k, x in [*AWKWARD, *more]:
        want[k, np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4").tobytes()] += 1
    whole = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length
        whole.setdefault((r.doc_id, r.doc_tokens), {}).setdefault(r.start, []).append(bytes(r.ids))
    got = Counter()
    for (k, total), parts in whole.items():
        n = max(map(len, parts.values()))
        data = b"".join(p[0] for _, p in sorted(parts.items()))
        assert len(data) == 4 * total or n > 1
        got[k, data] += n
    assert {k: v for k, v in got.items() if k[0] != 5} == {k: v for k, v in want.items() if k[0] != 5} and got[next(k for k in want if k[0] == 5)] == 2
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        end = 0
        for at, n in sorted(s):
            assert at == end
            end += n
        assert end <= 1024 and end & (end - 1) == 0
    assert packing.pack_documents(awkward.limit(0), path).count() == 0
    again = packing.pack_documents(df, path).select(F.crc32("ids").alias("c")).collect()
    assert Counter(r.c for r in again) == Counter(zlib.crc32(bytes(r.ids)) for r in rows)


def test_hilbert_curve_steps_are_neighbours():
    bits, d = 3, 2
    grid = np.array([(x, y) for x in range(8) for y in range(8)]) / 8 + 1e-6
    order = np.argsort(packing.hilbert(grid, bits))
    assert sorted(packing.hilbert(grid, bits)) == list(range(64))
    assert all(np.abs(np.diff(np.floor(grid[order] * 8), axis=0)).sum(1) == 1) and d == 2


# ---- 8 decontamination


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_against_the_plain_recurrence():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.integers(2, 6, rng.integers(1, 12)).astype(np.uint64), rng.integers(2, 6, rng.integers(1, 15)).astype(np.uint64)
        assert decontaminate.align(a[None], np.array([len(a)]), b[None])[0][0] == smith_waterman(a.tolist(), b.tolist())


def test_leaks(spark, docs, awkward):
    items = {r["item_id"]: r["text"] for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()}
    plain = lambda t: " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) + " "
    exact = {(k, i) for k, t in docs.items() for i, v in items.items() if plain(v) in plain(t)}
    got = {(r.doc_id, r.item_id): r.score for r in registry.queries()["op8_decontaminate"](spark, SF).collect()}
    assert exact and all(got.get(x) == 1.0 for x in exact)
    w = items[0].split()
    edited = " ".join(x if i % 6 else "changed" for i, x in enumerate(w))
    df = spark.createDataFrame([(1, "z " * 300 + edited + " z" * 300), (2, "z " * 500), (None, items[1]), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([*items.items(), (-1, None), (-2, ""), (-3, "ab")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, bench).collect()}
    assert {(1, 0), (None, 1)} <= got and not any(k in (2, 3) for k, _ in got)
    assert decontaminate.find_leaks(awkward.limit(0), bench).count() == 0 and decontaminate.find_leaks(df, bench.limit(0)).count() == 0


def test_leaks_edited_at_fixed_steps(spark):
    items = {(step, size): " ".join(f"w{step}x{size}x{i}" for i in range(size)) for step in (4, 5) for size in range(30, 60)}
    ids = {k: i for i, k in enumerate(items)}
    edited = [(ids[k], "z " * 40 + " ".join(w if (i + 1) % k[0] else "changed" for i, w in enumerate(t.split())) + " z" * 40) for k, t in items.items()]
    bench = spark.createDataFrame([(ids[k], t) for k, t in items.items()], "item_id long, text string")
    got = decontaminate.find_leaks(spark.createDataFrame(edited, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in ids.values()}
    assert all(r.score > 0.55 for r in got)


def test_leaks_of_rows_without_id(spark):
    item, other = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    df = spark.createDataFrame([(None, f"x {item} y"), (None, f"x {item} y"), (None, f"{item} {other}"), (None, "clean"), (5, "clean"), (5, other)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.score) for r in decontaminate.find_leaks(df, bench).collect()]
    assert sorted(got, key=repr) == sorted([(None, 1, 1.0), (None, 1, 1.0), (None, 2, 1.0), (5, 2, 1.0)], key=repr)


def test_leaks_of_items_of_one_and_two_words(spark):
    texts = ["a word b zebra c word", "red zebra", "zebra red", "", "redzebra", "x red zebra y red zebra", "word"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Word"), (2, "red zebra"), (3, "one two three"), (4, "none such")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.score, r.start_word, r.end_word) for r in decontaminate.find_leaks(df, bench).collect()}
    assert got.keys() == {(0, 1), (6, 1), (1, 2), (5, 2)} and all(v[0] == 1.0 for v in got.values())
    assert got[0, 1][2] == 2 and got[5, 2][2] == 3
    only = bench.filter("item_id < 3")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, only).collect()} == got.keys()


# ---- 9 embeddings


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SIDE", 40 * 40)
    monkeypatch.setattr(embeddings, "ROWS", 16)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 40))
    x = np.vstack([x, x[:40] + 0.2 * rng.normal(size=(40, 40)), x[:5] * 3, np.repeat(x[:1], 30, 0) + 0.05 * rng.normal(size=(30, 40))])
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)] + [(900, None, "e"), (901, [0.0] * 40, "e"), (902, [float("nan")] * 40, "e"), (903, [None, 1.0], "e"), (904, [], "e"), (905, [1.0, 2.0], "e"), (906, [2.0, 4.0], "e"), (907, [1.0, float("inf")], "e")]
    got = {r.vec_id: r for r in embeddings.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([label[near[i]].min() for i in range(len(x))])
    assert {k: (got[k].n_links, got[k].component_id) for k in range(len(x))} == {i: (near[i].sum() - 1, label[i]) for i in range(len(x))}
    assert all(got[k].n_links == 0 and got[k].kept for k in (900, 901, 902, 903, 904, 907))
    assert got[906].component_id == 905 and not got[906].kept and got[905].n_links == 1


# ---- 10 lines


def test_lines(spark, awkward):
    rows = [(i, f"Shared Line\n own {i}\n\n shared line \t") for i in range(10)] + [(10, "shared line\nÄ"), (11, "shared line")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("theirs"))
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(df).collect()}
    assert got[3] == (" own 3\n", 4, 2) and got[10] == ("shared line\nÄ", 2, 0) and got[11] == ("", 1, 1)
    rows = line_dedup.line_dedup(awkward).collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted(((k, t or "") for k, t in AWKWARD), key=repr)
    assert line_dedup.line_dedup(awkward.limit(0)).count() == 0
    assert not re.search("Python|Pandas|Arrow", line_dedup.line_dedup(df)._jdf.queryExecution().executedPlan().toString())
