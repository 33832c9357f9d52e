"""Secret scans with patterns and with character Markov models, by DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.lineage import cut

#: The base patterns and the least length of what they find (assign: of the value).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
#: What an assignment must contain, lower-cased.
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
#: Kinds in the order of ties.
KINDS = ["assign", "access", "hex", "markov"]

#: The models' alphabet; any other character, and what precedes the first, has index 0.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
N = len(ALPHABET) + 1
#: Weight of the characters' own frequencies in what follows a character.
PRIOR = 32
#: A token that the models judge: at least 20 characters of the alphabet.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"


#: A token that is labelled an ordinary identifier: no part of it mixes letters and digits.
ORDINARY = r"^[+/_=-]*([A-Za-z]+|[0-9]+)([+/_=-]+([A-Za-z]+|[0-9]+))*[+/_=-]*$"
#: What all finds but assignments hold: so many characters of the alphabet in a row.
LONG_RUN = r"[A-Za-z0-9+/_=-]{16}"

SPANS = "array<struct<start: int, rank: int, kind: string, end: int, found: string>>"


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """op of each value and all before it, by doubling steps: n log n work for n values, whatever their number."""

    def step(acc: Column, k: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda v, i: F.when(i >= width, op(v, F.get(acc, i - width))).otherwise(v))

    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")), values, step)


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost non-overlapping matches as an array of (start, rank, kind, end, found), in code points.

    The lengths of what lies between matches and of the matches add up to
    the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda a, b: F.char_length(a) + F.char_length(b))
    return F.zip_with(
        running(sizes, lambda a, b: a + b),
        found,
        lambda end, x: F.struct((end - F.char_length(x)).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), x.alias("found")),
    )


def _only(when: Column, spans: Column) -> Column:
    return F.when(when, spans).otherwise(F.expr(f"cast(array() as {SPANS})"))


def _clear(merged: Column) -> Column:
    """The tokens among spans sorted by start that overlap none of the base spans."""
    token = lambda x: x["kind"] == "markov"
    before = running(F.transform(merged, lambda x: F.when(token(x), 0).otherwise(x["end"])), F.greatest)
    after = F.reverse(running(F.reverse(F.transform(merged, lambda x: F.when(token(x), 2**31 - 1).otherwise(x["start"]))), F.least))
    free = F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a")))
    judged = F.zip_with(merged, free, lambda x, f: F.struct(x.alias("x"), (token(x) & (f["b"] <= x["start"]) & (f["a"] >= x["end"])).alias("ok")))
    return F.transform(F.filter(judged, lambda j: j["ok"]), lambda j: j["x"])


def find_spans(df: DataFrame, text: str) -> DataFrame:
    """df with __base, the base spans, and __tokens, the tokens that overlap none of them."""
    t = F.col("__text")
    low = F.lower(t)
    has_word = F.lit(False)
    for w in ASSIGN_WORDS:
        has_word = has_word | F.contains(low, F.lit(w))
    out = df.withColumn("__text", F.coalesce(F.col(text), F.lit(""))).withColumns({"__word": has_word, "__run": F.rlike(t, F.lit(LONG_RUN))})
    assign = F.filter(_only(F.col("__word"), _spans(t, ASSIGN, "assign")), lambda x: F.char_length(F.regexp_extract(x["found"], ASSIGN, 2)) >= LEAST_ASSIGN)
    access = F.filter(_only(F.col("__run") & F.contains(t, F.lit("AKIA")), _spans(t, ACCESS, "access")), lambda x: x["end"] - x["start"] >= LEAST_ACCESS)
    hexes = _only(F.col("__run") & F.rlike(t, F.lit(HEX)), _spans(t, HEX, "hex"))
    tokens = _only(F.col("__run"), _spans(t, TOKEN, "markov"))
    out = out.withColumns({"__assign": assign, "__access": access, "__hex": hexes, "__tokens": tokens}).drop("__text", "__word", "__run")
    out = out.withColumn("__base", F.array_sort(F.concat("__assign", "__access", "__hex"))).drop("__assign", "__access", "__hex")
    both = (F.size("__base") > 0) & (F.size("__tokens") > 0)
    return out.withColumn("__merged", F.when(both, F.array_sort(F.concat("__base", "__tokens")))).withColumn("__tokens", F.when(both, _clear(F.col("__merged"))).otherwise(F.col("__tokens"))).drop("__merged")


def _value(span: Column) -> Column:
    """What a base span hides: an assignment's value, else all of it."""
    return F.when(span["kind"] == "assign", F.regexp_extract(span["found"], ASSIGN, 2)).otherwise(span["found"])


def _indexes(s: Column) -> Column:
    return F.transform(F.split(s, ""), lambda c: F.position(c, F.lit(ALPHABET)))


def _ratio(token: Column, ratios: list[float]) -> Column:
    """The log-likelihood ratio of a token's characters, each after the one before it."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    i = _indexes(token)
    before = F.concat(F.array(F.lit(0)), F.slice(i, F.lit(1), F.size(i) - 1))
    return F.aggregate(F.zip_with(before, i, lambda a, b: F.element_at(table, a * N + b + 1)), F.lit(0.0), lambda acc, x: acc + x)


def train_models(spans: DataFrame, rounds: int = 2) -> list[float]:
    """Log-likelihood ratios of character pairs, random strings against ordinary identifiers.

    spans is the result of find_spans. Labelled samples are all base spans
    (random strings) and all tokens of which no part mixes letters and digits
    (identifiers); each round after the first takes for identifiers the
    tokens that the round before finds likelier to be ordinary, so that what
    no pattern finds is not learned as ordinary. Spark counts pairs of all
    samples, and the N x N ratios, a table of fixed size, come to the driver.
    Each character's followers count as PRIOR more, shared as characters are
    over all. Entry a * N + b is of b after a.
    """
    random = F.transform("__base", lambda b: F.struct(F.lit(1).alias("random"), _value(b).alias("s")))
    plain = F.transform("__tokens", lambda b: F.struct(F.lit(0).alias("random"), b["found"].alias("s")))
    samples = spans.select(F.explode(F.concat(random, plain)).alias("x")).select("x.random", "x.s")
    out: list[float] = []
    for _ in range(rounds):
        own = samples.filter((F.col("random") == 1) | (_ratio(F.col("s"), out) < 0 if out else F.rlike("s", F.lit(ORDINARY))))
        own = own.select("random", _indexes(F.col("s")).alias("i"))
        pairs = own.select("random", F.explode(F.zip_with(F.concat(F.array(F.lit(0)), F.slice("i", F.lit(1), F.size("i") - 1)), "i", lambda a, b: a * N + b)).alias("pair"))
        count = {(r.random, r.pair): r.n for r in pairs.groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}
        model = []
        for k in (0, 1):
            one = [1 + sum(count.get((k, a * N + b), 0) for a in range(N)) for b in range(N)]
            share = [x / sum(one) for x in one]
            rows = [sum(count.get((k, a * N + b), 0) for b in range(N)) for a in range(N)]
            model.append([(count.get((k, a * N + b), 0) + PRIOR * share[b]) / (rows[a] + PRIOR) for a in range(N) for b in range(N)])
        out = [math.log(r / i) for i, r in zip(*model)]
    return out


def judge_spans(spans: DataFrame, ratios: list[float], min_ratio: float = 10.0) -> DataFrame:
    """spans, the result of find_spans, with secrets and their numbers in place of what it found."""
    more = F.filter("__tokens", lambda x: _ratio(x["found"], ratios) >= min_ratio)
    n = lambda kind: F.size(F.filter("__base", lambda x: x["kind"] == kind)).cast("long")
    every = F.transform(F.array_sort(F.concat(F.col("__base"), more)), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return spans.withColumns({"secrets": every, "n_assign": n("assign"), "n_access": n("access"), "n_hex": n("hex")}).drop("__base", "__tokens")


def secret_scan(df: DataFrame, ratios: list[float], text: str = "text", min_ratio: float = 10.0) -> DataFrame:
    """df with `secrets`, an array of (start, kind, end), and n_assign, n_access, n_hex (long).

    Base kinds follow the patterns above, leftmost and non-overlapping within
    a kind; shorter finds are dropped after matching. A token that overlaps no
    base span is a secret of kind markov when the log-likelihood ratio of its
    characters (train_models) is at least min_ratio. Spans are in code points,
    end exclusive, sorted by start and then by kind in the order of KINDS.

    A null or empty text has none. Each row is judged by itself, so repeated
    rows, ties and ids do not matter; other columns pass through but for those
    of the four names. Nothing is shuffled; time and memory of a text of n
    finds grow as n log n.
    """
    return judge_spans(find_spans(df.drop("secrets", "n_assign", "n_access", "n_hex"), text), ratios, min_ratio)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are read once: what their patterns find is written, and the models are trained and applied on that."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = cut(find_spans(docs, "text").drop("text"))
    found = judge_spans(spans, train_models(spans))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda x: x["kind"] != "markov")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("secrets")).alias("spans"))
