"""Exact n-gram Jaccard join of whole documents, skipping by set relations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.packing import ragged
from tidemark.llm.words import NOT_SPACE, Words, mix, signed, steps
from tidemark.plans.lineage import cut

#: Counters of the frequency sketch (4 MiB, whatever the corpus), and of them in a block that is shuffled.
COUNTERS, BLOCK = 1 << 20, 1 << 12
#: Minimum hashes by which sets find a likely leader, and members that one verification task compares with a leader.
LEADER_HASHES, MEMBERS = 12, 256
#: Similarity to its leader from which a set is in the leader's group, and shingles of a group that one task holds against each other.
NEAR, GROUP_SHINGLES = 0.25, 1 << 20

_SEEDS = np.random.default_rng(5).integers(1, 2**63, 2 + LEADER_HASHES, dtype=np.uint64)
_LOW = np.uint64(64 - 20)


def _sets(words: Words, n: int) -> list[np.ndarray]:
    """Each text's set of shingle hashes, sorted."""
    out: list[list[np.ndarray]] = [[] for _ in range(len(words))]
    for doc, _, key in words.gram_runs(n):
        at = np.flatnonzero(np.diff(doc, prepend=-1))
        for d, part in zip(doc[at].tolist(), np.split(key, at[1:])):
            out[d].append(part)
    for d, key in zip(*words.short_grams(n)):
        out[d].append(np.array([key]))
    return [np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64) for parts in out]


def _signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    return tuple(int(mix(s ^ k).sum(dtype=np.uint64).view(np.int64)) for k in _SEEDS[:2])


def _order(texts: DataFrame, n: int) -> np.ndarray:
    """A rank for each hash bucket, rare buckets first, from counts over all texts.

    Any order makes the join exact; this one leaves common shingles out of
    prefixes. Tasks send fixed-size counters, which are added up by block.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, words in steps(batch.column(0), NOT_SPACE):
                for key in [*(x[2] for x in words.gram_runs(n)), words.short_grams(n)[1]]:
                    total += np.bincount((key >> _LOW).astype(np.int64), minlength=COUNTERS)
        blocks = [total[i : i + BLOCK].astype("<u4" if total.max() < 2**32 else "<u8") for i in range(0, COUNTERS, BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], ["block", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for c in table.column("counts").to_pylist():
            total += np.frombuffer(c, "<u4" if len(c) == 4 * BLOCK else "<u8").astype(np.int64)
        return pa.table({"block": table.column("block")[:1], "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    got = texts.select("text").mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary").toArrow()
    total = np.zeros(COUNTERS, np.int64)
    for b, c in zip(got.column("block").to_pylist(), got.column("counts").to_pylist()):
        total[b * BLOCK : (b + 1) * BLOCK] = np.frombuffer(c, "<i8")
    rank = np.empty(COUNTERS, np.uint32)
    rank[np.argsort(total, kind="stable")] = np.arange(COUNTERS, dtype=np.uint32)
    return rank


def _digest(texts: DataFrame, kind: str, n: int, rank: np.ndarray, num: int, den: int) -> DataFrame:
    """For each row its set's size, signature, minimum hashes and prefix, rarest elements first.

    The rank of a hash's bucket in place of the bucket is a bijection of
    hashes, so an element's number is its place in the order. A set's prefix
    is long enough that linked sets share an element of both prefixes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words in steps(batch.column(1), NOT_SPACE):
                out = []
                for s in _sets(words, n):
                    if not len(s):
                        out.append((0, 0, 0, [], []))
                        continue
                    least = [int(mix(s ^ k).min().view(np.int64)) for k in _SEEDS[2:]]
                    placed = np.sort((rank[(s >> _LOW).astype(np.int64)].astype(np.uint64) << _LOW) | (s & np.uint64((1 << 44) - 1)))
                    prefix = len(s) - -(-num * len(s) // den) + 1
                    out.append((len(s), *_signature(s), least, signed(placed[:prefix])))
                cols = list(zip(*out))
                longs = pa.list_(pa.int64())
                arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), longs, longs))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(out)), *arrays], ["id", "n", "s1", "s2", "least", "prefix"])

    return texts.mapInArrow(run, f"id {kind}, n long, s1 long, s2 long, least array<long>, prefix array<long>")


def _verify(pairs: DataFrame, names: DataFrame, texts: DataFrame, kind: str, n: int) -> DataFrame:
    """a, b, na, nb and the size of the intersection, for pairs (a, b) of ids, from their whole texts.

    Texts meet at the first of a pair. A first with many seconds is sent to
    several tasks, each with at most about MEMBERS of them.
    """
    pairs = cut(pairs)
    tasks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("k"))
    seconds = pairs.join(tasks, "a").select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), "k").alias("chunk"), F.lit(1).alias("role"))
    firsts = tasks.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("chunk"), F.lit(0).alias("role"))
    wanted = seconds.union(firsts).join(names, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first = None, None
        for batch in batches:
            a, chunk, role, ids, s1, s2 = (batch.column(c).to_pylist() for c in ("a", "chunk", "role", "id", "s1", "s2"))
            out = []
            for row, words in steps(batch.column(batch.schema.get_field_index("text")), NOT_SPACE):
                for i, s in enumerate(_sets(words, n), row):
                    if _signature(s) != (s1[i], s2[i]):
                        continue  # another row of this id
                    if role[i] == 0:
                        at, first = (a[i], chunk[i]), s
                    elif at == (a[i], chunk[i]):
                        out.append((a[i], ids[i], len(first), len(s), len(np.intersect1d(first, s, assume_unique=True))))
            if out:
                cols = list(zip(*out))
                kind_ = batch.schema.field("a").type
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind_, kind_, pa.int64(), pa.int64(), pa.int64()))], ["a", "b", "na", "nb", "both"])

    met = texts.join(wanted, "id").select("a", "chunk", "role", "id", "s1", "s2", "text")
    return met.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "role", "id").mapInArrow(run, f"a {kind}, b {kind}, na long, nb long, both long")


class Lists:
    """Index lists of some sets: for each element the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        size = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        self.n = len(sets)
        self.elements, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.holders = np.repeat(np.arange(self.n), size)[order]

    def shared(self, elements: np.ndarray) -> np.ndarray:
        """How many of the elements each set holds."""
        at = np.minimum(np.searchsorted(self.elements, elements), len(self.elements) - 1)
        at = at[self.elements[at] == elements]
        return np.bincount(self.holders[ragged(self.first[at], self.count[at])], minlength=self.n)


def _answers(sets: list[np.ndarray], lists: Lists) -> Iterator[np.ndarray]:
    """For each set the sizes of its intersections with all sets of the lists.

    A set's answers are derived from those of the set before it, when the two
    differ in fewer elements than the set has: elements that it lacks are
    taken off, those that it has besides are added.
    """
    before, known = np.zeros(0, np.uint64), np.zeros(lists.n, np.int64)
    for s in sets:
        lost, won = np.setdiff1d(before, s, assume_unique=True), np.setdiff1d(s, before, assume_unique=True)
        known = known - lists.shared(lost) + lists.shared(won) if len(lost) + len(won) < len(s) else lists.shared(s)
        before = s
        yield known


def _join_groups(groups: DataFrame, names: DataFrame, texts: DataFrame, kind: str, n: int, num: int, den: int) -> DataFrame:
    """a, b: links that join different components of the sets within a group, as few as connect them, from whole texts.

    groups: g, id, n (size of the set), component. A group's sets are dealt in
    blocks of about GROUP_SHINGLES; a task holds two of them, builds the index
    lists of one and runs the sets of the other over it. No pairs leave it.
    """
    blocks = groups.groupBy("g").agg(F.ceil(F.sum("n") / GROUP_SHINGLES).alias("k"))
    own = groups.join(blocks, "g").withColumn("own", F.pmod(F.xxhash64("id"), "k"))
    partner = F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))
    wanted = own.withColumn("other", partner).select(
        "g", "id", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side")
    ).join(names, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides = None, ([], [])  # of the task's two blocks: id, component, set

        def join() -> list[tuple]:
            held, probes = sides[0], sides[1] or sides[0]
            if not held or at[1] != at[2] and not sides[1]:
                return []
            root: dict = {}

            def top(c):
                while root.get(c, c) != c:
                    root[c] = c = root.get(root[c], root[c])
                return c

            size = np.array([len(x[2]) for x in held], np.int64)
            numbers = {c: i for i, c in enumerate(dict.fromkeys(x[1] for x in held))}
            number = np.array([numbers[x[1]] for x in held])
            # sets of a component, then likely alike ones, follow each other
            probes = sorted(probes, key=lambda x: (str(x[1]), x[2][:4].tolist()))
            lists, out = Lists([x[2] for x in held]), []
            for (id_, component, s), both in zip(probes, _answers([x[2] for x in probes], lists)):
                linked = np.flatnonzero((both * den >= (size + len(s) - both) * num) & (number != numbers.get(component, -1)))
                _, one = np.unique(number[linked], return_index=True)  # one link for each component
                for i in linked[one].tolist():
                    x, y = top(component), top(held[i][1])
                    if x != y:
                        root[x] = y
                        out.append((id_, held[i][0]))
            return out

        for batch in batches:
            found = []
            cols = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            g, i, j, side, ids, component, s1, s2 = (cols[c].to_pylist() for c in ("g", "i", "j", "side", "id", "component", "s1", "s2"))
            for row, words in steps(cols["text"], NOT_SPACE):
                for r, s in enumerate(_sets(words, n), row):
                    if (g[r], i[r], j[r]) != at:
                        found += join() if at else []
                        at, sides = (g[r], i[r], j[r]), ([], [])
                    if _signature(s) == (s1[r], s2[r]):  # and not another row of this id
                        sides[side[r]].append((ids[r], component[r], s))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, batch.schema.field("id").type) for c in zip(*found)], ["a", "b"])
        if at and (found := join()):
            yield pa.RecordBatch.from_arrays([pa.array(c, batch.schema.field("id").type) for c in zip(*found)], ["a", "b"])

    met = texts.join(wanted, "id").select("g", "i", "j", "side", "id", "component", "s1", "s2", "text")
    return met.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "side", "id").mapInArrow(run, f"a {kind}, b {kind}")


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, component) after links (a, b) of ids have joined their components."""
    a, b = (labels.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")) for c in ("a", "b"))
    edges = cut(links.join(a, "a").join(b, "b").filter("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    if not edges.head(1):
        return labels
    top = components(edges).withColumnRenamed("node", "component")
    return cut(labels.join(top, "component", "left").select("id", F.coalesce("label", "component").alias("component")))


def similar_documents(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row for each id of df: id, n_shingles, component_id; documents link when their Jaccard similarity is num/den or more.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a
    document's set is its distinct n-word shingles, or its whole sequence
    with fewer words. Links are exact: den * intersection >= num * union.
    component_id is the smallest id reachable by links. Sets of no shingles
    (null, empty or blank texts) link with nothing. Rows that share an id are
    one document, that of the largest set; rows with a null id come back one
    by one with a null component_id and link with nothing. Extra columns are
    ignored; an empty table gives an empty result.

    1. Equal sets are one (a partly summed groupBy on their signatures).
    2. Each set is compared with the smallest holder of each of its minimum
       hashes, its leaders; those that link are components so far. Of the
       leaders that a set resembles, that with most followers is its group.
    3. Within a group that holds several components, index lists are built
       and every set is run over them. Its answers are derived from those of
       the set before it by the elements in which the two differ. Tasks hold
       blocks of a group and send on only the links that join components.
    4. Index lists over all prefix elements, rarest elements first: a list is
       cut in blocks, one for each group, with bounds of size and position. A
       list within one component holds no news and is skipped; two blocks are
       skipped when their bounds rule a link out, and so are, in blocks that
       meet, pairs of sets. What is left is verified.

    No step emits the pairs of a group: groups are compared inside tasks, by
    blocks, and 4. has pairs between groups only. A set in no group is one of
    its own. Of a group's sets that link with nothing each is still run over
    all others (in a task), as their answers are needed. Texts are shuffled
    for 2, 3 and the verification of 4.
    """
    kind = df.schema[id].dataType.simpleString()
    texts = df.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    digest = cut(_digest(texts, kind, n, _order(texts, n), num, den))
    texts = texts.filter(F.col("id").isNotNull())
    union = F.col("na") + F.col("nb") - F.col("both")
    linked = F.col("both") * den >= union * num

    # 1. documents, and a representative of each set
    documents = digest.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.struct("n", "s1", "s2")).alias("x")).select("id", "x.*")
    sets = documents.filter("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("id"), F.max("n").alias("n"))
    reps = cut(digest.dropDuplicates(["id", "s1", "s2"]).join(sets.select("id", "s1", "s2"), ["id", "s1", "s2"]))
    names = reps.select("id", "s1", "s2")

    # 2. leaders, components and groups
    hashes = reps.select("id", "n", F.posexplode("least").alias("j", "h"))
    leader = hashes.groupBy("j", "h").agg(F.min(F.struct("id", "n")).alias("x"), F.count(F.lit(1)).alias("many")).filter("many > 1").select("j", "h", F.col("x.id").alias("a"), F.col("x.n").alias("na"))
    likely = hashes.join(leader, ["j", "h"]).filter((F.col("id") != F.col("a")) & (F.least("n", "na") * den >= F.greatest("n", "na") * num)).select("a", F.col("id").alias("b")).distinct()
    tried = cut(_verify(likely, names, texts, kind, n).filter(F.col("both") >= union * NEAR).select("a", "b", linked.alias("linked")))
    label = components(tried.filter("linked").select("a", "b")).withColumnRenamed("node", "id")
    labels = cut(reps.select("id").join(label, "id", "left").select("id", F.coalesce("label", "id").alias("component")))
    follow = tried.select(F.col("a").alias("g"), F.col("b").alias("id")).union(tried.select("a", "a").distinct())
    most = follow.groupBy("g").agg(F.count(F.lit(1)).alias("many"))
    group = cut(follow.join(most, "g").groupBy("id").agg(F.min_by("g", F.struct(-F.col("many"), F.col("g"))).alias("g")))

    # 3. groups of several components
    members = group.join(labels, "id").join(reps.select("id", "n"), "id")
    mixed = members.groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("g")
    labels = _merge(labels, cut(_join_groups(cut(members.join(mixed, "g")), names, texts, kind, n, num, den)))

    # 4. lists that hold several components, a block for each group
    entries = reps.select("id", "n", "prefix").join(group, "id", "left").join(labels, "id").select("id", "n", "component", F.coalesce("g", "id").alias("g"), F.posexplode("prefix").alias("at", "e"))
    entries = cut(entries)
    news = cut(entries.groupBy("e").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("g").alias("one"), F.max("g").alias("other")).filter("lo < hi and one < other").select("e"))
    lists = cut(entries.join(news, "e"))
    blocks = cut(lists.groupBy("e", "g").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("at").alias("at"), F.min("component").alias("lo"), F.max("component").alias("hi")))
    x, y = blocks.alias("x"), blocks.alias("y")
    sizes = (F.col("x.most") * den >= F.col("y.least") * num) & (F.col("y.most") * den >= F.col("x.least") * num)
    places = F.least(F.col("x.most") - F.col("x.at"), F.col("y.most") - F.col("y.at")) * (num + den) >= (F.col("x.least") + F.col("y.least")) * num
    apart = (F.col("x.lo") != F.col("y.lo")) | (F.col("x.hi") != F.col("y.hi")) | (F.col("x.lo") != F.col("x.hi"))
    meet = x.join(y, (F.col("x.e") == F.col("y.e")) & (F.col("x.g") < F.col("y.g")) & apart & sizes & places).select(F.col("x.e").alias("e"), F.col("x.g").alias("g"), F.col("y.g").alias("h"))
    side = lambda g, c: lists.select("e", F.col("g").alias(g), F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("at").alias(f"at{c}"), F.col("component").alias(f"c{c}"))
    near = (
        (F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
        & (F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb")) * (num + den) >= (F.col("na") + F.col("nb")) * num)
        & (F.col("ca") != F.col("cb"))
    )
    pairs = meet.join(side("g", "a"), ["e", "g"]).join(side("h", "b"), ["e", "h"]).filter(near).select("a", "b").distinct()
    labels = _merge(labels, cut(_verify(pairs, names, texts, kind, n).filter(linked).select("a", "b")))
    by_set = cut(names.join(labels, "id").select("s1", "s2", "component"))
    out = cut(documents).join(by_set, ["s1", "s2"], "left").select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))
    nameless = digest.filter(F.col("id").isNull()).select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return out.union(nameless)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similar_documents(docs, n=4, num=85, den=100)
