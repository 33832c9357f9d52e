"""HTML extraction, ranked lexical search and tokenizer alignment: brute force, awkward inputs and the registered queries."""

import hashlib
import html as references
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from helpers import duck, spark_rows

from tidemark.llm import alignment, html, lexical, registry

SF = "/root/testdata/sf0.001"


# ---- 11 HTML extraction


def texts_of(spark, rows):
    got = html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    return {r.page_id: r.text for r in got.collect()}


def plain_article(page):
    own = page[page.index("<article>") + 9 : page.index("</article>")]
    parts = (" ".join(references.unescape(re.sub("</?b>", "", x)).split()) for x in re.split("</?(?:p|h1|br|article)>", own))
    return " ".join(p for p in parts if p)


def test_pages_of_the_table(spark):
    want = {r["page_id"]: plain_article(r["html"]) for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    got = registry.queries()["op11_html_extraction"](spark, SF).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got) and {r.url for r in got} == set(pq.read_table(f"{SF}/pages.parquet")["url"].to_pylist())


def test_shared_lines_go_where_no_article_is_named(spark):
    page = lambda *own: "<body><div>Daily Planet</div><p>" + "</p><p>".join(own) + "</p><div>Call us today</div></body>"
    rows = [
        (1, "http://a.example/x/1", page("one is here", "one more", "and a third line of it")),
        (2, "http://a.example/x/2", page("two is here", "two again", "and something else at the end")),
        (3, "http://b.example/x/1", page("alone on its host")),
        (4, None, page("no address")),
        (5, "http://a.example/x/2?print=1", page("two is here", "two again", "and something else at the end")),  # a copy says nothing of templates
    ]
    got = texts_of(spark, rows)
    assert got[1] == "one is here one more and a third line of it"
    assert got[2] == got[5] == "two is here two again and something else at the end"
    assert got[3] == "Daily Planet alone on its host Call us today"  # nothing to compare with
    assert got[4] == "Daily Planet no address Call us today"


def test_shared_lines_of_an_article_stay(spark):
    page = lambda own: f"<nav>menu</nav><article><p>the same words</p><p>{own}</p></article><p>outside</p>"
    got = texts_of(spark, [(i, f"http://a.example/{i}", page(f"own words {i}")) for i in range(3)])
    assert got == {i: f"the same words own words {i}" for i in range(3)}


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<article>a<b>b</b>c &amp;amp; &lt;i&gt;&#x41;</article>", "abc &amp; <i>A"),
        ("<article><p>one<p>two<br>three\n\t four</article>", "one two three four"),
        ("<article><script>var t='</p>';</script><style>p{}</style>x<!-- y --></article>", "x"),
        ("<article>x<script>never closed", "x"),
        ("<article>a < b and 1<2 &lt;</article>", "a < b and 1<2 <"),
        ('<article><a title="x>y">link</a> <a href="open>rest</a></article>', "link rest"),
        ("<article><header><h1>Title</h1><p>by me</p></header><p>text</p><div class='comments'><p>first!</p></div></article>", "Title text"),
        ("<body class='has-sidebar'><div id='sidebar'>s</div><main>m<form>f</form></main><div class=\"cookie-notice\">c</div></body>", "m"),
        ("<main>around<article>in</article></main>", "in"),
        ("<div class='article with-ads'><p>x</p><div class='ad'>buy</div></div>", "x"),
        ("<article>a<ul><li>b<li>c</ul><table><tr><td>d<td>e</table><p hidden>z</p></article>", "a b c d e"),
        ("<article><p><b>open<p>next</p></article><footer>f", "open next"),
        ("<article>a<span class='share'>tweet</span>b</article>", "a b"),
    ],
)
def test_markup(spark, page, want):
    lines = html.lines_of(page or "")
    article = any(k == html.ARTICLE for k, _, _ in lines)
    assert " ".join(t for k, _, t in lines if k == html.ARTICLE or k == html.OPEN and not article) == want


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_subsequences():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (rng.integers(0, 5, rng.integers(0, 15)) for _ in range(2))
        at = html.common(a, b)
        rest = iter(b.tolist())
        assert len(at) == plain_lcs(a.tolist(), b.tolist()) and all(x in rest for x in a[at].tolist())


def test_nearest_page_does_not_depend_on_partitions(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, f"http://h.example/{i % 7}/{i}", "".join(f"<p>line {x}</p>" for x in rng.integers(0, 40, 12))) for i in range(120)]
    want = texts_of(spark, rows)
    monkeypatch.setattr(html, "BLOCK", 5)
    assert texts_of(spark, rows) == want
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert texts_of(spark, rows[::-1]) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_html_awkward_tables(spark):
    schema = "page_id long, url string, html string, text string, row string, host string"
    none = html.extract_text(spark.createDataFrame([], schema))
    assert none.columns == ["page_id", "url", "text", "n_chars"] and none.count() == 0
    rows = [(None, None, None, "t", "r", "h"), (1, "http://a/b", "<p>x</p>", "t", "r", "h"), (1, "http://a/b", "<p>x</p>", "t", "r", "h"), (1, "not a url", "<p>y</p>", "t", "r", "h")]
    got = html.extract_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "x", 1), (1, "x", 1), (1, "y", 1)]
    assert len(texts_of(spark, [(1, "http://a/", "<article>" + "<p>word &amp; word</p>" * 200_000)])[1]) == 200_000 * 12 - 1


# ---- 12 ranked lexical search


def plain_ranks(docs, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in held:
            s = 0
            for t in terms(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    s += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (25 + 75 * n * n_docs // n_terms)))
            if s > 0:
                found.append((-s, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def ranks(df):
    return sorted(tuple(r) for r in df.collect())


def test_search_of_the_table(spark):
    assert spark_rows(registry.queries()["op12_ranked_lexical_search"](spark, SF)) == duck(SF, registry.oracle_sql()["op12_ranked_lexical_search"])


@pytest.mark.parametrize("cells, held, tile", [(1 << 22, 1 << 17, 1 << 23), (64, 3, 1 << 23), (256, 40, 200)])
def test_search_by_brute_force(spark, monkeypatch, cells, held, tile):
    for name, value in (("CELLS", cells), ("HELD", held), ("TILE_BYTES", tile), ("ITEMS", 3)):
        monkeypatch.setattr(lexical, name, value)
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(rng.choice(["a", "B", "c1", "Ä", "ä", "dd", "e-f", "x" * 30], n, p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.05, 0.03, 0.02]))
    docs = [(i, word(rng.integers(0, 30))) for i in range(150)] + [(1000 + i, "tie tie a") for i in range(25)] + [(500, None), (501, ""), (502, "--")]
    items = [(i, word(rng.integers(0, 12))) for i in range(11)] + [(50, "tie"), (51, None), (52, ""), (53, "nowhere")]
    got = lexical.lexical_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert ranks(got) == plain_ranks(docs, items)


def test_search_splits_sums_that_float64_cannot_hold(spark, monkeypatch):
    monkeypatch.setattr(lexical, "EXACT", 40_000_000_000)  # a term of weight 20,000 fits twice
    docs, items = [(i, "rare " * (i % 3) + f"w{i} common") for i in range(40)], [(1, "rare " * 50 + "w3 w4 w5 common"), (2, "common " * 7)]
    got = lexical.lexical_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert ranks(got) == plain_ranks(docs, items)
    tile = lexical.Tile(0, [(np.array([0, 1]), np.array([50, 3]))], np.array([15_000, 15_000]))
    most = (lexical.EXACT - 1) // lexical.IMPACT
    assert sum(w.sum() for _, w in tile.parts) == 53 * 15_000 and all(w.sum(0).max() <= most for _, w in tile.parts)


def test_search_awkward_tables(spark):
    schema = "{} {}, text string, score string, rank string, item string"
    docs, items = [("b", "x y", "", "", ""), (None, "x y", "", "", ""), ("a", "x y", "", "", ""), ("a", "x y", "", "", "")], [(7, "x", "", "", ""), (7, "y", "", "", ""), (None, "x", "", "", "")]
    d, i = spark.createDataFrame(docs, schema.format("doc_id", "string")), spark.createDataFrame(items, schema.format("item_id", "int"))
    got = lexical.lexical_search(d, i)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    rows = got.collect()
    assert sorted(Counter(r.item_id for r in rows).items(), key=repr) == [(7, 8), (None, 4)]
    assert [r.doc_id for r in sorted((r for r in rows if r.item_id is None), key=lambda r: r.rank)] == ["a", "a", "b", None]
    assert lexical.lexical_search(d.limit(0), i).count() == lexical.lexical_search(d, i.limit(0)).count() == 0


# ---- 13 tokenizer alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  a  b", "a\n\nb c", "a  b", "a  b", "a   b", "x\x00y z", "▁ a ▁", "é è　 b", "<|endoftext|> <s> </s> <unk> x", "a\t b", "a \tb", " a", "a ", "𝄞 𝄞𝄞", "a\x1c b", "\x85 b c", "日本語 テキスト", "a " * 50, "don't you 'll we've 123 4567 !!! ??", "ab" * 300, "same words here", "same words here"]


def plain_alignment(texts):
    """From whole texts, with every pair of tokens compared where their byte ranges may overlap."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    assert ByteLevel().decode([a.id_to_token(a.encode(" é").ids[0])]) == " é"
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = dict(zip(map(chr, letters), letters)) | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in letters)}

    def spans(parts):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        return list(zip([0, *ends], ends))

    rows, counts = [], Counter()
    for t in texts:
        rows.append(None)
        if not t:
            continue
        ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
        if b"".join(bytes_a) != (" " + t).encode() or b"".join(bytes_b) != (" " + t).encode():
            continue
        at_a, at_b = spans(bytes_a), spans(bytes_b)
        links, q = [], 0
        for i, (lo, hi) in enumerate(at_a):
            while at_b[q][1] <= lo:
                q += 1
            p = q
            while p < len(at_b) and at_b[p][0] < hi:
                links.append((ids_a[i], ids_b[p]))
                p += 1
        groups, x, y = [], [], []
        ends = {e for _, e in at_a} & {e for _, e in at_b}
        a_of, b_of = {e: [] for e in ends}, {e: [] for e in ends}
        order = sorted(ends)
        for ids, at, of in ((ids_a, at_a, a_of), (ids_b, at_b, b_of)):
            k = 0
            for i, (_, hi) in zip(ids, at):
                while order[k] < hi:
                    k += 1
                of[order[k]].append(i)
        groups = [",".join(map(str, a_of[e])) + "|" + ",".join(map(str, b_of[e])) for e in order]
        rows[-1] = (len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
        counts.update(links)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(counts[x] == best[x[1]] for x in r[3]), sum(counts[x] for x in r[3]), r[4]) for r in rows]


def test_alignment_of_the_table(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    want = dict(zip(docs["doc_id"], plain_alignment(docs["text"])))
    assert {r[0]: tuple(r)[1:] for r in registry.queries()["op13_tokenizer_alignment"](spark, SF).collect()} == want


@pytest.mark.parametrize("chunk, run, joined", [(1 << 24, 1 << 20, 256), (40, 10, 1)])
def test_alignment_of_odd_texts(spark, monkeypatch, chunk, run, joined):
    for name, value in (("CHUNK_BYTES", chunk), ("RUN_BYTES", run), ("JOINED", joined)):
        monkeypatch.setattr(alignment, name, value)
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in alignment.align_tokenizers(df, A, B).collect()}
    assert got == dict(enumerate(plain_alignment(ODD)))
    assert [i for i, r in got.items() if r[0] == 0] == [0, 1, 9]


def test_groups_and_links():
    a_ends, b_ends = [2, 5, 6, 9], [3, 6, 7, 9]
    assert [x.tolist() for x in alignment.group_tokens(a_ends, b_ends)] == [[3, 4], [2, 4]]
    a, b, cuts = alignment.link_tokens(np.array(a_ends), np.array(b_ends))
    assert list(zip(a.tolist(), b.tolist())) == [(0, 0), (1, 0), (1, 1), (2, 1), (3, 2), (3, 3)] and cuts.tolist() == [2, 3, 5, 6, 7, 9]


def test_alignment_awkward_tables(spark):
    schema = "doc_id string, text string, chunk long, pairs string, n_a string"
    none = alignment.align_tokenizers(spark.createDataFrame([], schema), A, B)
    assert none.count() == 0 and none.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = [(None, "a b", 1, "", ""), (None, None, 1, "", ""), ("x", "a b", 1, "", ""), ("x", "a b", 1, "", "")]
    got = sorted((r.doc_id or "", r.n_links, r.n_best, r.count_sum) for r in alignment.align_tokenizers(spark.createDataFrame(rows, schema), A, B).collect())
    assert got == [("", 0, 0, 0), ("", 2, 2, 6), ("x", 2, 2, 6), ("x", 2, 2, 6)]
    only = alignment.align_tokenizers(spark.createDataFrame([(None, None, 1, "", "")], schema), A, B).collect()
    assert [tuple(r) for r in only] == [(None, 0, 0, 0, 0, 0, 0, "")]
