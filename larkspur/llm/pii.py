"""Personal data by bootstrapped contextual extraction.

Base patterns find e-mail addresses, IPv4 addresses, payment cards (Luhn) and phone numbers; these spans always stay.
They are also the seeds, and so are long mixed runs of letters and digits, for a kind of its own, secrets. The two words before a
mention and the two words after it are its contexts; a context with a kind is a lexical pattern. Words and runs of digit groups that
could be an identifier (many digits, or an address written around its sign) are candidates.

Spark scores the graph of contexts and distinct instances in rounds, until no new instance is found. A pattern's confidence is the
share of all places of its context, in all texts, that a believed instance of its kind stands in, candidates that aren't believed
yet counting half; it is accepted with ``MIN_SEEDS`` distinct believed instances and ``CONFIDENCE``. A candidate's belief is the noisy-or of the confidences of the accepted patterns
that it stands in; believed candidates count like seeds from then on, so they induce patterns in whatever other contexts they have.
In the end the candidates in accepted patterns of a fitting kind are marked.

Texts are read in Arrow batches, whole: once for mentions, and once more to count the contexts that could become patterns, if there
are any. What follows moves contexts and spans, never texts. Edges are summed by context and instance before they are joined, so
a very common context or instance adds one line per pair.

Defined results: a null or empty text has no spans; rows that share an identifier are searched each on its own;
added spans never overlap base spans; spans are ordered by start, then kind as listed, then end; secrets are listed apart from the
four kinds; empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import mix, stage, text_chunks, tidy, word_hashes, word_spans

KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS)
MIN_SEEDS = 5
CONFIDENCE = 0.7
ROUNDS = 10
#: Up to so many contexts are sent to all tasks to count their places; beyond that all contexts are counted and joined.
CONTEXTS = 2_000_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = re.compile(r"[\[({]at[\])}]", re.IGNORECASE)
_MIXED = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{32,128}(?![A-Za-z0-9_])")
#: Digit groups with up to two signs or spaces between them.
_GROUPS = re.compile(r"[(+]?[0-9]+(?:\)?[\x20.-]{1,2}\(?[0-9]+)+")
#: Words with four digits or more, or with a sign that an address could be written around.
_ODD = re.compile(r"[^\x20\x09-\x0D]*(?:(?:[0-9][^\x20\x09-\x0D0-9]*){4}|[@\[({])[^\x20\x09-\x0D]*")
_DIGIT = np.zeros(256, np.uint8)
_DIGIT[48:58] = 1
_SIGN = np.zeros(256, np.uint8)
_SIGN[list(b"@[({")] = 1
_HEAD = np.ones(256, bool)  # bytes that begin a code point
_HEAD[0x80:0xC0] = False
_ZEROS = np.arange(256, dtype=np.uint8)
_ZEROS[48:58] = 48


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping. The address's first part is the run before its sign, back to the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > done and text[left - 1] in _LOCAL:
            left -= 1
        if left < at and (m := _DOMAIN.match(text, at)):
            done = m.end()
            yield left, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base matches, by start, then kind."""
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out)


def _secret(word: str) -> bool:
    digits = sum(c in "0123456789" for c in word)
    return 8 <= digits <= len(word) - 4


def _shape(word: str) -> int:
    """Bits of the kinds that a word could be an instance of."""
    digits = sum(c in "0123456789" for c in word)
    own = (bool(_AT.search(word)), digits >= 2 and len(re.findall(r"[.:]", word)) >= 3, 12 <= digits <= 19, 7 <= digits <= 15)
    return sum(int(x) << k for k, x in enumerate((*own, len(word) >= 16 and digits >= 4 and _secret(word))))


def found_in(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Base spans, and all mentions as (start, end, kind or -1, shape): seeds and candidates, by start. Candidates overlap nothing."""
    base = base_spans(text)
    seeds = [(a, b, k, 0) for a, k, b in base]
    taken = sorted((a, b) for a, _, b in base)
    seeds += [(m.start(), m.end(), SECRET, 0) for m in _MIXED.finditer(text) if _secret(m[0]) and _free(taken, m.start(), m.end())]
    taken = _merged([(a, b) for a, b, _, _ in seeds])
    spans = [m.span() for m in _GROUPS.finditer(text)]
    spans = [(a, b) for a, b in spans if 7 <= sum(c in "0123456789" for c in text[a:b]) <= 19]
    groups = _merged(spans)
    for m in _ODD.finditer(text):
        a, b = m.span()
        while a < b and not (text[a].isalnum() or text[a] in "[({"):
            a += 1
        while b > a and not (text[b - 1].isalnum() or text[b - 1] in "])}"):
            b -= 1
        if b - a >= 6 and _free(groups, a, b):
            spans.append((a, b))
    out = [(a, b, -1, shape) for a, b in spans if _free(taken, a, b) and (shape := _shape(text[a:b]))]
    return base, sorted(seeds + out)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _free(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether a span overlaps none of these, which are sorted."""
    k = bisect_left(taken, (b, 0))
    return not (k and taken[k - 1][1] > a)


def _key(instance: str) -> int:
    return int.from_bytes(hashlib.blake2b(instance.lower().encode(), digest_size=8).digest(), "little", signed=True)


def bigrams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of words, and the hash of each word with the one after it; digits are alike, and so are cases of A-Z."""
    starts, ends, row = word_spans(buf, offs)
    h = word_hashes(_ZEROS[buf], starts, ends, lower=True)
    return starts, ends, row, mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]).view(np.int64)


_SPAN = "array<struct<start:long,kind:int,end:long>>"
_MENTION = "array<struct<start:long,end:long,kind:int,shape:int,instance:long,left:long,right:long>>"


def extract(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A staged line per row: row number, identifier, base spans, mentions with the hashes of their contexts (null at a text's ends)."""
    kind = docs.schema[id_col].dataType.simpleString()
    span_t = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    long = ("start", "end", "instance", "left", "right")
    keys = ("start", "end", "kind", "shape", "instance", "left", "right")
    mention_t = pa.list_(pa.struct([(k, pa.int64() if k in long else pa.int32()) for k in keys]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            spans: list[list] = []
            found: list[list] = []
            for lo, hi, buf, offs in text_chunks(batch, "text"):
                marks = np.zeros(len(buf) + 1, np.int64)
                np.cumsum(_DIGIT[buf] + np.uint8(4) * _SIGN[buf], out=marks[1:], dtype=np.int64)
                likely = marks[offs[1:]] - marks[offs[:-1]] >= 4  # four digits, or a sign of an address
                for i in range(hi - lo):
                    base, mentions = found_in(texts[lo + i].as_py()) if likely[i] else ([], [])
                    spans.append([{"start": a, "kind": k, "end": b} for a, k, b in base])
                    found.append([])
                    if not mentions:
                        continue
                    text, own = texts[lo + i].as_py(), buf[offs[i] : offs[i + 1]]
                    at = np.append(np.flatnonzero(_HEAD[own]), len(own))  # bytes before each code point
                    starts, ends, _, pair = bigrams(own, np.array([0, len(own)]))
                    for a, b, k, shape in mentions:
                        first, last = np.searchsorted(ends, at[a], "right"), np.searchsorted(starts, at[b]) - 1
                        left = int(pair[first - 2]) if first >= 2 else None
                        right = int(pair[last + 1]) if last + 1 < len(pair) else None
                        found[-1].append(dict(zip(keys, (a, b, k, shape, _key(text[a:b]), left, right), strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, span_t), pa.array(found, mention_t)], names=["id", "base", "mentions"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(tidy(run), f"id {kind}, base {_SPAN}, mentions {_MENTION}")
    return stage(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "pii-rows")


def _places(docs: DataFrame, text_col: str, contexts: DataFrame) -> DataFrame:
    """(pair, places): how often each of these pairs of words stands in any text."""
    n = contexts.count()
    wanted = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in contexts.collect()], np.int64)) if n <= CONTEXTS else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value
        for batch in batches:
            for _, _, buf, offs in text_chunks(batch, "text"):
                _, _, row, pair = bigrams(buf, offs)
                pair = pair[row[1:] == row[:-1]]
                if known is not None:
                    pair = pair[known[np.minimum(np.searchsorted(known, pair), len(known) - 1)] == pair]
                if len(pair):
                    value, times = np.unique(pair, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(times.astype(np.int64))], names=["pair", "places"])

    counted = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(tidy(run), "pair long, places long").groupBy("pair").agg(F.sum("places").alias("places"))
    return counted if n <= CONTEXTS else counted.join(contexts, "pair", "left_semi")


def _sides(rows: DataFrame) -> DataFrame:
    """A line per mention and side: row, start, end, kind, shape, instance, side (0 left, 1 right), pair."""
    mentions = rows.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    both = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("pair")), F.struct(F.lit(1).alias("side"), F.col("right").alias("pair")))).alias("c")
    return mentions.select("row", "start", "end", "kind", "shape", "instance", both).select("row", "start", "end", "kind", "shape", "instance", "c.side", "c.pair").filter("pair IS NOT NULL")


def patterns(rows: DataFrame, docs: DataFrame, text_col: str, min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame | None:
    """(side, pair, as_kind, confidence) of the accepted patterns, the best kind of each context. None where no context has enough instances."""
    edges = _sides(rows).groupBy("side", "pair", "instance", "kind").agg(F.max("shape").alias("shape"), F.count(F.lit(1)).alias("times"))
    able = edges.groupBy("side", "pair").agg(F.count_distinct("instance").alias("n")).filter(F.col("n") >= min_seeds)
    able = stage(able.select("side", "pair"), "pii-contexts")
    if able.isEmpty():
        return None
    places = stage(_places(docs, text_col, able.select("pair").distinct()), "pii-places")
    # An edge for each kind that an instance could have there: a seed's own, and those of a candidate's shape.
    kinds = F.when(F.col("kind") >= 0, F.array("kind")).otherwise(F.filter(F.array(*[F.lit(k) for k in range(SECRET + 1)]), lambda k: F.expr("shape").bitwiseAND(F.pow(F.lit(2), k).cast("int")) > 0))
    graph = edges.join(able, ["side", "pair"]).withColumn("as_kind", F.explode(kinds)).groupBy("side", "pair", "as_kind", "instance").agg(F.max("kind").alias("kind"), F.sum("times").alias("times"))
    graph = stage(graph.join(places, "pair"), "pii-graph")
    believed, before, good = graph.filter("kind >= 0").select("instance", "as_kind").distinct(), -1, None
    for _ in range(rounds):
        told = graph.join(believed.withColumn("known", F.lit(True)), ["instance", "as_kind"], "left")
        worth = F.when(F.col("known"), F.col("times")).otherwise(F.col("times") / 2)  # what isn't known here is a candidate
        scored = told.groupBy("side", "pair", "as_kind").agg(F.count("known").alias("seeds"), (F.sum(worth) / F.first("places")).alias("confidence"))
        good = stage(scored.filter((F.col("seeds") >= min_seeds) & (F.col("confidence") >= confidence)).drop("seeds"), "pii-patterns")
        doubt = graph.filter("kind < 0").join(good, ["side", "pair", "as_kind"]).groupBy("instance", "as_kind").agg(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))).alias("doubt"))
        new = doubt.filter(1 - F.exp("doubt") >= confidence).select("instance", "as_kind")
        believed = stage(graph.filter("kind >= 0").select("instance", "as_kind").unionAll(new).distinct(), "pii-believed")
        if (now := believed.count()) == before:
            break
        before = now
    best = Window.partitionBy("side", "pair").orderBy(F.col("confidence").desc(), "as_kind")
    return good.withColumn("_place", F.row_number().over(best)).filter("_place = 1").drop("_place")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row for every row: identifier, counts of the four kinds over base spans, base_sha256, spans (text), n_added, secrets (text), n_secret, n_found."""
    rows = extract(docs, id_col, text_col)
    good = patterns(rows, docs, text_col, **options)
    seeds = rows.select("row", F.explode("mentions").alias("m")).filter(F.col("m.kind") == SECRET).select("row", "m.start", F.lit(SECRET).alias("kind"), "m.end")
    if good is not None:
        # A candidate in patterns of several kinds goes to the most confident.
        fits = _sides(rows).filter("kind < 0").join(good, ["side", "pair"]).filter("(shiftright(shape, as_kind) & 1) = 1")
        kind = fits.groupBy("row", "start", "end").agg(F.max_by("as_kind", F.struct("confidence", -F.col("as_kind"))).alias("kind"))
        seeds = seeds.unionAll(kind.select("row", "start", "kind", "end"))
    added = seeds.groupBy("row").agg(F.collect_set(F.struct("start", "kind", "end")).alias("added"))
    name = F.array(*[F.lit(k) for k in (*KINDS, "secret")])

    def written(spans):
        return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    both = rows.select("row", F.col("id").alias(id_col), "base").join(added, "row", "left")

    def of_kind(k):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    counts = [of_kind(k).alias(f"n_{n}") for k, n in enumerate(KINDS)]
    every = F.coalesce("added", F.array().cast(_SPAN))
    extra, secrets = F.filter(every, lambda s: s["kind"] < SECRET), F.filter(every, lambda s: s["kind"] == SECRET)
    return both.select(
        id_col, *counts, F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.concat("base", extra)).alias("spans"), F.size(extra).cast("long").alias("n_added"),
        written(secrets).alias("secrets"), F.size(secrets).cast("long").alias("n_secret"), (F.size("base") + F.size(every)).cast("long").alias("n_found"),
    )
