"""Main text of web pages by differencing each with its nearest page of the same host."""

from __future__ import annotations

import hashlib
import html as references
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.lineage import cut

# Elements of HTML by what they are to a reader.
#: Elements that stand apart from the text around them; all others are in line with it.
BLOCKS = frozenset(
    "address article aside blockquote body br canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content isn't markup, up to their end tag, and elements that have no content.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW_END = {name: re.compile(f"</{name}", re.IGNORECASE) for name in RAW}
#: Elements that are never main text.
FURNITURE = frozenset("head title nav header footer aside form script style textarea xmp iframe noembed noframes noscript template button select option dialog menu search svg object audio video canvas".split())
#: Words in class, id and role that say the same of any element, and first words of names that only tell what a layout has.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsors sponsored promo promos promotion promotions nav navs navbar navigation navi menu menus breadcrumb breadcrumbs pagination pager "
    "header headers masthead topbar footer footers contentinfo complementary sidebar sidebars aside asides widget widgets related recommended recommendations cookie cookies consent gdpr notice notices alert alerts popup popups modal modals overlay overlays "
    "newsletter newsletters subscribe subscription subscriptions signup login search searchbox form forms share sharing social comment comments commentlist respond replies disqus discussion skiplink copyright legal disclaimer disclaimers".split()
)
LAYOUT_WORDS = frozenset("has with no without is".split())
#: Open elements that a start tag ends by itself: (the tag, what it ends, where the search for it stops).
P_ENDERS = BLOCKS - {"br", "body", "html", "head", "title", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "legend"}
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: A tag's attributes up to its end; quotes count behind an equals sign only, and one that nothing closes is a letter.
REST = re.compile(r"(?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']*)))?")

#: What a line of text is: named as furniture, inside the named article, or neither.
NAMED, ARTICLE, OPEN = 0, 1, 2
#: Pages before and after a page, in the order of paths, among which its nearest is found.
REACH = 2
#: Pages in the order of paths that one task holds against each other.
BLOCK = 4096
#: Share of a page's open text, by characters, that a pair may share; beyond it the pages are copies and their pair says nothing of templates.
COPY = 0.8


def _tags(page: str) -> Iterator[tuple[str, str, str]]:
    """(text before, tag with a slash before an end tag's name, attributes) in order; the rest of the text last, with an empty tag."""
    at = start = 0
    n = len(page)
    while True:
        lt = page.find("<", at)
        if lt < 0 or lt + 1 >= n:
            yield page[start:], "", ""
            return
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            yield page[start:lt], "!", ""
            at = start = n if end < 0 else end + 3
        elif page[lt + 1] in "!?":
            end = page.find(">", lt)
            yield page[start:lt], "!", ""
            at = start = n if end < 0 else end + 1
        elif m := TAG.match(page, lt + 1):
            rest = REST.match(page, m.end())
            end = rest.end() if rest else n
            name = m[2].lower()
            yield page[start:lt], m[1] + name, page[m.end() : end - 1]
            at = start = end
            if name in RAW and not m[1]:
                close = RAW_END[name].search(page, end)
                at = start = close.start() if close else n
        else:
            at = lt + 1  # a plain <


def _attributes(said: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(said)}


def _named(said: str, inside: int) -> bool:
    """Whether a class, id or role says that an element is furniture; an article's own header holds its title."""
    for name in references.unescape(said).lower().split():
        words = re.split(r"[-_]+", name)
        if words[0] not in LAYOUT_WORDS and any(w in FURNITURE_WORDS and not (inside == ARTICLE and w.startswith("header")) for w in words):
            return True
    return False


def _role(name: str, said: str, inside: int) -> int:
    """What an element's own start tag says it is."""
    if name in FURNITURE:
        return NAMED
    found = _attributes(said) if said else {}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.IGNORECASE):
        return NAMED
    if name not in ("html", "body", "main") and any(_named(found.get(a, ""), inside) for a in ("class", "id", "role")):
        return NAMED
    if name in ("article", "main") or found.get("role", "").lower() == "main" or found.get("itemprop", "").lower() == "articlebody":
        return ARTICLE
    return OPEN


def lines_of(page: str) -> list[tuple[int, str, str]]:
    """The blocks of text of a page in order: (kind, path of the elements around it, text).

    Character references are decoded, white space is one space, blocks
    without text are left out. Inside the named article headings of its own
    header are part of it. Where a page names articles, its main element
    counts for nothing beyond them.
    """
    out: list[tuple[int, str, str, bool]] = []
    stack: list[tuple[str, int, bool]] = []  # open elements: name, kind inside, inside an article element
    said: list[str] = []
    kind, inside = OPEN, False

    def flush() -> None:
        text = " ".join(references.unescape("".join(said)).split()) if said else ""
        said.clear()
        if text:
            out.append((kind, ">".join(s[0] for s in stack if s[0] in BLOCKS), text, inside))

    def close(to: int) -> None:
        nonlocal kind, inside
        flush()
        del stack[to:]
        kind, inside = (stack[-1][1], stack[-1][2]) if stack else (OPEN, False)

    for text, tag, attributes in _tags(page):
        if text:
            said.append(text)
        if not tag or tag == "!":
            continue
        if tag[0] == "/":
            name = tag[1:]
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            if name in BLOCKS:
                flush()
            if i >= 0 and (name in BLOCKS or not any(s[0] in BLOCKS for s in stack[i + 1 :])):
                if name in BLOCKS or stack[i][1] != (stack[i - 1][1] if i else OPEN):
                    close(i)
                else:
                    del stack[i:]
            continue
        if tag in BLOCKS:
            flush()
        if tag in P_ENDERS:
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCKS), -1)
            if i >= 0 and stack[i][0] == "p":
                close(i)
        if tag in ENDS:
            ended, stop = ENDS[tag]
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in ended or stack[i][0] in stop), -1)
            if i >= 0 and stack[i][0] in ended:
                close(i)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        role = _role(tag, attributes, kind)
        heading = len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"
        if kind == NAMED and not (heading and role != NAMED and stack[-1][0] == "header" and any(s[1] == ARTICLE for s in stack)):
            now = NAMED
        elif role == NAMED:
            now = NAMED
        else:
            now = ARTICLE if kind != OPEN or role == ARTICLE else OPEN
        if now != kind:
            flush()
        stack.append((tag, now, inside or tag == "article" and now == ARTICLE))
        kind, inside = now, stack[-1][2]
    flush()
    articles = any(k == ARTICLE and within for k, _, _, within in out)
    return [(OPEN if articles and k == ARTICLE and not within else k, path, text) for k, path, text, within in out]


def _key(kind: int, path: str, text: str) -> int:
    """What must be equal for two lines to be aligned: the text, or, where the markup names furniture, its place, whose text may change from page to page."""
    said = f"{path}\0" if kind == NAMED else text
    return int.from_bytes(hashlib.blake2b(said.encode(), digest_size=8).digest(), "little", signed=True)


def _rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of a and each prefix of b, by whole rows of bits."""
    full = (1 << len(b)) - 1
    places: dict[int, int] = {}
    for i, x in enumerate(b.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    row = full
    for x in a.tolist():
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer((~row & full).to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places in a of a longest common subsequence with b, in memory that grows with their lengths only."""
    n = min(len(a), len(b))
    same = np.flatnonzero(a[:n] != b[:n])
    head = int(same[0]) if len(same) else n
    same = np.flatnonzero(a[head:][::-1][: n - head] != b[head:][::-1][: n - head])
    tail = int(same[0]) if len(same) else n - head
    ends = np.concatenate([np.arange(head), np.arange(len(a) - tail, len(a))])
    own_a = head + np.flatnonzero(np.isin(a[head : len(a) - tail], b[head : len(b) - tail]))
    own_b = b[head : len(b) - tail]
    own_b = own_b[np.isin(own_b, a[own_a])]
    return np.sort(np.concatenate([ends, own_a[_halves(a[own_a], own_b)]]))


def _halves(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As `common`: a is halved where prefixes and suffixes of b fit its halves best."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64)
    if len(a) == 1:
        return np.arange(1) if (b == a[0]).any() else np.zeros(0, np.int64)
    half = len(a) // 2
    best = int(np.argmax(_rows(a[:half], b) + _rows(a[half:][::-1], b[::-1])[::-1]))
    return np.concatenate([_halves(a[:half], b[:best]), half + _halves(a[half:], b[best:])])


def _shared(own: dict, others: list[dict]) -> list[int]:
    """Places of the lines that a page shares with its nearest page.

    Nearest is who has most leading segments of the path in common, then who
    is next in the order of paths, the one before first. A page with all the
    same lines, or nearly all of its open text, is a copy, and the next
    nearest counts.
    """
    keys, size = np.array(own["keys"], np.int64), np.array(own["sizes"], np.int64)
    segments = own["path"].split("/")

    def nearness(o: tuple[int, dict]) -> tuple:
        theirs = o[1]["path"].split("/")
        alike = next((i for i, (x, y) in enumerate(zip(segments, theirs)) if x != y), min(len(segments), len(theirs)))
        return -alike, abs(o[0]), o[0]

    for _, other in sorted(others, key=nearness):
        theirs = np.array(other["keys"], np.int64)
        if len(keys) == len(theirs) and (keys == theirs).all():
            continue
        at = common(keys, theirs)
        if size[at].sum() <= COPY * size.sum() or not size.sum():
            return at.tolist()
    return []


def extract_text(pages: DataFrame, html: str = "html", url: str = "url", id: str = "page_id") -> DataFrame:
    """Each page's main text: id, url, text (empty if none) and n_chars.

    A page's lines are its blocks of text. In the order of paths within a
    host a page's nearest page is among the REACH before and after it; the
    lines of both are aligned by a longest common subsequence, and shared
    lines are taken for the template and deleted. Lines that the markup names
    as furniture (menus, headers, footers, sidebars, notices, adverts, forms,
    scripts, styles, comments, hidden elements) are aligned by their place, as
    adverts and menus change their words from page to page, and go even where
    no page aligns with them, as with the only page of a host. Lines of an
    element that the markup names as the article stay even if shared: an
    article that quotes another, or is a copy of it, is whole. Where a page
    has an article, lines outside it go; where it has none, the lines that
    neither the markup nor the differences delete are its text.

    Character references are decoded once, white space inside a block is one
    space, blocks are joined by one space. Null and empty html has no text. A
    null url has no host and no neighbours. Rows with the same id, url and
    html have the same result each; null and repeated ids stay apart
    otherwise. Extra columns are ignored; an empty table gives an empty
    result. Broken markup (open tags, quotes and comments) ends nothing early
    but what HTML itself says.

    Neighbours are found among rows of hashes, sorted by range partitions, so
    a host that holds most pages is in many tasks, and then dealt in blocks of
    numbered rows that overlap by REACH. Pages are read twice, parsed page
    by page, and shuffled once, to meet the places that are to go.
    """
    kind = pages.schema[id].dataType.simpleString()
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    # what tells rows apart, up to equal ones
    rows = rows.withColumn("row", F.md5(F.to_json(F.struct(F.col("id").cast("string").alias("id"), "url", F.md5("html").alias("html")))))
    bare = F.regexp_replace(F.trim("url"), r"[?#].*$", "")
    host = F.lower(F.regexp_extract(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@]*@)?([^/]*)", 1))
    path = F.regexp_replace(F.regexp_replace(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/]*", ""), r"/+$", "")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = [], []
            for page in batch.column(4):
                lines = lines_of(page.as_py())
                keys.append([_key(*x) for x in lines])
                sizes.append([len(x[2]) if x[0] == OPEN else 0 for x in lines])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))], ["row", "host", "url", "path", "keys", "sizes"])

    known = rows.filter("url is not null").select("row", host.alias("host"), "url", path.alias("path"), "html")
    shape = "row string, host string, url string, path string, keys array<long>, sizes array<int>"
    order = ["host", "path", "url", "row"]
    sorted_ = known.mapInArrow(digest, shape).dropDuplicates(["row"]).repartitionByRange(*order).sortWithinPartitions(*order)
    digests = cut(sorted_.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    # a row's number in the whole order, then blocks of rows with the REACH before and after each
    parts = digests.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))  # a row for each partition
    number = F.col("before") + F.col("at")
    dealt = digests.join(F.broadcast(parts.select("part", "before")), "part").withColumn("at", number).drop("part", "before")
    block = lambda x: F.floor(x / BLOCK)
    dealt = dealt.withColumn("block", F.explode(F.array_distinct(F.array(block(F.col("at")), block(F.col("at") - REACH), block(F.col("at") + REACH)))))

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []  # the row that is judged next, with up to REACH before and after it
        place = 0

        def judge() -> tuple[str, list[int]] | None:
            own = held[place]
            near = [(o["at"] - own["at"], o) for o in held if o["host"] == own["host"] and o["block"] == own["block"] and 0 < abs(o["at"] - own["at"]) <= REACH and own["host"]]
            return (own["row"], _shared(own, near)) if own["at"] // BLOCK == own["block"] else None

        def out(found: list) -> pa.RecordBatch:
            found = [f for f in found if f is not None]
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.list_(pa.int32()))], ["row", "shared"])

        for batch in batches:
            found = []
            for row in batch.to_pylist():
                held.append(row)
                if len(held) - place > REACH:
                    found.append(judge())
                    place += 1
                if place > REACH:
                    held.pop(0)
                    place -= 1
            yield out(found)
        found = []
        while place < len(held):
            found.append(judge())
            place += 1
        yield out(found)

    shared = dealt.repartition("block").sortWithinPartitions("block", "at").mapInArrow(differ, "row string, shared array<int>")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, gone in zip(batch.column(2), batch.column(3).to_pylist()):
                lines, gone = lines_of(page.as_py()), set(gone or ())
                article = any(k == ARTICLE for k, _, _ in lines)
                texts.append(" ".join(text for i, (k, _, text) in enumerate(lines) if k == ARTICLE or k == OPEN and not article and i not in gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    out = rows.join(shared, "row", "left").select("id", "url", "html", "shared").mapInArrow(take, f"id {kind}, url string, text string")
    return out.select(F.col("id").alias(id), F.col("url").alias(url), "text", F.char_length("text").cast("long").alias("n_chars"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
