"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Texts become sets of hashed 5-word shingles; sets, not documents, are joined, so exact copies count once. Two sets
link from a Jaccard similarity of 0.8 on. The search divides inverted lists into short and long ones:

1. One pass over the texts gives each document its set's hash and size, and the shingles that occur in at
   least ``LOCAL`` sets of a batch. Those that add up to a share ``HOT`` of all documents are long lists.
   A list counts as long from a share of all documents and from a millionth of all shingles on, so there are at most
   a million long lists however large the corpus is, and they can be broadcast.
2. A second pass orders each set: shingles of short lists first, then long ones by rising frequency. Linked sets
   share one of the first n - ceil(0.8 n) + 1 shingles of both; only these are indexed, by shingle, each with the
   set's sketch: 32 places of four bits.
3. Spark's sort merges the short lists. In each list, sets of fitting sizes whose sketches agree in a third of the
   places are joined (linked sets agree in 0.8 on average; a link is lost with a probability under 1e-8); those of fewer than
   ``SKETCHED_FROM`` shingles where they differ in no more places than linked sets can, so that no link is lost. A list
   gives each joined set once, with the first set that it is joined to, directly or by others: the rows grow with the
   index, not with the pairs. Lists beyond ``WIDE``, which only sets made of long-list shingles have, join all members.
4. Connected candidates form families. The members' sets are computed once more from their texts and searched in
   blocks of at most ``BLOCK`` sets and ``SHINGLES`` shingles. For each set the short lists of its block are heap-merged, and
   candidates that can still reach the overlap are looked up in the long lists by binary search. Links are exact
   counts. A block reports the links that join two groups, at most one for each member, never all pairs.
   A family beyond a block is first dealt out twice, by size band and by bands half a step on, so each member is in two
   blocks; mostly this leaves one component. Only what is still in different components is then compared block against
   block, and blocks of one component are not compared with each other.
5. Components of the links, and of rows that share an identifier, give the classes.

Hashes have 64 bits. With ``exact`` the sketches aren't asked. Defined results: null texts and texts without words have size 0 and
link with nothing; texts of fewer than five words have one shingle, all their words; rows that share an identifier are one node,
linked if any of their texts is; a null identifier links with nothing and has a null component; an empty table gives an empty table.
Identifiers are integers.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import mix, partitions, stage, text_chunks, tidy, window_hashes, word_hashes, word_spans
from larkspur.llm.components import components

WORDS = 5
HOT = 2e-4
LOCAL = 3
#: Lists up to this are compared many at once, longer ones set by set, those beyond WIDE not at all.
LIST = 64
WIDE = 16_384
BLOCK = 512
SHINGLES = 2_000_000
#: At most so many lists are long.
LONG_LISTS = 1_000_000
#: Short lists with more places than this are merged by sorting them together.
HEAP = 4096
PLACES = 32
AGREE = 1 / 3
#: Sketches of sets smaller than this are compared by the places where they differ, which no link is lost by.
SKETCHED_FROM = 96
_BAND = math.log(1.25) / 2 * 1.000001
_ONE = np.uint64(1)


# --------------------------------------------------------------------------- sets


def shingle_sets(buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a run."""
    n = len(offs) - 1
    starts, ends, row = word_spans(buf, offs)
    h = word_hashes(buf, starts, ends, lower=True)
    grams, first = window_hashes(h, row, WORDS)
    cut = np.searchsorted(row[first], np.arange(n + 1)) if len(first) else np.zeros(n + 1, np.int64)
    words = np.searchsorted(row, np.arange(n + 1))
    out = []
    for i in range(n):
        a, b = cut[i], cut[i + 1]
        if b > a:
            out.append(np.unique(grams[a:b]))
        else:
            few = h[words[i] : words[i + 1]]
            x = np.full(min(len(few), 1), len(few), np.uint64)
            for w in few:
                x = mix(x * np.uint64(31) + w)
            out.append(x)
    return out


def set_key(s: np.ndarray) -> int:
    """One 64-bit hash of a set, never 0; 0 for the empty set."""
    if not len(s):
        return 0
    x = np.array([mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(s))])
    return int((mix(x) | _ONE).view(np.int64)[0])


_EDGES = np.append(np.arange(PLACES, dtype=np.uint64) * np.uint64(2**64 // PLACES), np.uint64(2**64 - 1))


_SHIFTS = np.tile(np.arange(16, dtype=np.uint64) * np.uint64(4), 2)
_NIBBLES = np.uint64(0x1111111111111111)


def sketch(s: np.ndarray) -> np.ndarray:
    """Two words of four bits, 1 to 15, of the least shingle in each of 32 ranges; 0 for an empty range."""
    at = np.searchsorted(s, _EDGES)
    full = at[:-1] < at[1:]
    out = np.zeros(PLACES, np.uint64)
    out[full] = (s[at[:-1][full]] >> np.uint64(20)) % np.uint64(15) + _ONE
    return (out << _SHIFTS).reshape(2, 16).sum(1, dtype=np.uint64)


def _filled(x: np.ndarray) -> np.ndarray:
    return (x | x >> np.uint64(1) | x >> np.uint64(2) | x >> np.uint64(3)) & _NIBBLES


def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sketches agree in AGREE of the places that either has filled; a and b end in two words."""
    same = np.bitwise_count(_filled(a) & ~_filled(a ^ b)).sum(-1, dtype=np.int64)
    return same >= AGREE * np.bitwise_count(_filled(a | b)).sum(-1, dtype=np.int64)


def within(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether sketches differ in no more places than those of linked sets can; sizes: of both sets together.

    Linked sets have at most a ninth of ``sizes`` shingles that are in one of them only, and each changes one place at most.
    """
    return 9 * np.bitwise_count(_filled(a ^ b)).sum(-1, dtype=np.int64) <= sizes


def least_overlap(n: int) -> int:
    """ceil(0.8 n): what a set of n shares with any linked one."""
    return -(-4 * n // 5)


def linked(shared: int, n: int, m: int) -> bool:
    return 100 * shared >= 80 * (n + m - shared)


# --------------------------------------------------------------------------- passes over the texts


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc", "key", "n", "long"]
    pending, have = [], 0

    def hot() -> pa.RecordBatch:
        token, count = np.unique(np.concatenate(pending), return_counts=True)
        keep = count >= LOCAL
        m = int(keep.sum())
        return pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.array(token[keep].view(np.int64)), pa.array(count[keep].astype(np.int32)), pa.array(np.ones(m, bool))], names=names)

    for batch in batches:
        for lo, hi, buf, offs in text_chunks(batch, "text"):
            sets = shingle_sets(buf, offs)
            keys = [set_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(np.zeros(len(sets), bool))], names=names
            )
            pending += [s for s in sets if len(s)]
            have += sum(map(len, sets))
            if have > 3_000_000:
                yield hot()
                pending, have = [], 0
    if pending:
        yield hot()


def prefix(s: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles of a set that are indexed: short lists by hash, then long lists by rising frequency."""
    need = len(s) - least_overlap(len(s)) + 1
    for head in (s[: 2 * need + 8], s):
        at = np.searchsorted(hot, head)
        at[at == len(hot)] = 0
        long = hot[at] == head if len(hot) else np.zeros(len(head), bool)
        cold = head[~long]
        if len(cold) >= need:
            return cold[:need]
    order = np.argsort(rank[at[long]])
    return np.concatenate([cold, head[long][order][: need - len(cold)]])


def roots(a: np.ndarray, b: np.ndarray, m: int) -> np.ndarray:
    """The least node that each of m nodes is connected with by the edges (a, b)."""
    label = np.arange(m)
    while True:
        was = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, was[a], low)
        np.minimum.at(label, was[b], low)
        label = label[label]
        if (label == was).all():
            return label


def _joined(exact: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (token, key, n, s0, s1), sorted: sets of each list with the first set that they are joined to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        found: list[np.ndarray] = []
        size = 0

        def work(token: np.ndarray, key: np.ndarray, n: np.ndarray, s0: np.ndarray, s1: np.ndarray) -> Iterator[np.ndarray]:
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
            token, key, n = token[fresh], key[fresh], n[fresh].astype(np.int64)
            words = np.column_stack([s0[fresh], s1[fresh]]).view(np.uint64)
            start = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
            length = np.diff(np.append(start, len(token)))

            def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                """a and b: places, or one place and several."""
                least, most = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
                fit = 5 * least >= 4 * most
                return fit if exact else fit & np.where(least < SKETCHED_FROM, within(words[a], words[b], least + most), similar(words[a], words[b]))

            for m in np.unique(length[length > 1]):
                at = start[length == m]
                if m <= LIST:
                    i, j = np.triu_indices(m, 1)
                    step = max(1, 300_000 // len(i))
                    for k in range(0, len(at), step):
                        members = at[k : k + step, None] + np.arange(m)
                        a, b = (np.arange(len(members))[:, None] * m + i).ravel(), (np.arange(len(members))[:, None] * m + j).ravel()
                        members = members.ravel()
                        fit = fits(members[a], members[b])
                        root = roots(a[fit], b[fit], len(members))
                        moved = np.flatnonzero(root != np.arange(len(members)))
                        yield np.column_stack([key[members[root[moved]]], key[members[moved]]])
                else:
                    for k in at:
                        yield from spread(np.arange(k, k + m), key, fits)

        def spread(left: np.ndarray, key: np.ndarray, fits: Callable) -> Iterator[np.ndarray]:
            """A long list: from its first set to all that fit it, from these to all that fit them, and so on, then from the first that is left."""
            if len(left) > WIDE:
                yield np.column_stack([np.full(len(left) - 1, key[left[0]]), key[left[1:]]])
                return
            while len(left) > 1:
                root, front, left = left[0], left[:1], left[1:]
                while len(front) and len(left):
                    if len(front) <= len(left):
                        hit = np.zeros(len(left), bool)
                        for x in front:
                            open_ = np.flatnonzero(~hit)
                            hit[open_] = fits(x, left[open_])
                    else:
                        hit = np.array([fits(x, front).any() for x in left])
                    front, left = left[hit], left[~hit]
                    if len(front):
                        yield np.column_stack([np.full(len(front), key[root]), key[front]])

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(found)
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            fresh = np.append(True, (rows[1:] != rows[:-1]).any(1))
            return pa.RecordBatch.from_arrays([pa.array(rows[fresh, 0]), pa.array(rows[fresh, 1])], names=["a", "b"])

        def take(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal found, size
            for rows in work(*columns):
                if len(rows):
                    found.append(rows)
                    size += len(rows)
                if size > 600_000:
                    yield flush()
                    found, size = [], 0

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
            if not len(columns[0]):
                continue
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            rest = [c[cut:] for c in columns]
            yield from take(*[c[:cut] for c in columns])
        if rest is not None:
            yield from take(*rest)
        if found:
            yield flush()

    return run


# --------------------------------------------------------------------------- search inside a family


def merge_lists(lists: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """The members of sorted lists, ascending, and how many of the lists have them."""
    if sum(map(len, lists)) > HEAP:
        yield from zip(*(x.tolist() for x in np.unique(np.concatenate(lists), return_counts=True)), strict=True)
        return
    for member, run in itertools.groupby(heapq.merge(*(x.tolist() for x in lists))):
        yield member, sum(1 for _ in run)


def divide_skip(keys: np.ndarray, sets: list[np.ndarray], side: np.ndarray, component: np.ndarray) -> list[tuple[int, int]]:
    """Links that join two groups of a block's members; those of one component are one group from the start.

    side: 0 and 1 where only pairs across count, 2 where all do.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(m), size)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
    lists, stops = tokens[starts], np.append(starts[1:], len(tokens))
    places = np.repeat(np.arange(len(lists)), stops - starts) * m + owner  # sorted: a list is a run, its members ascend
    group, out = np.unique(component, return_inverse=True)[1], []
    for x in range(m):
        fits = (group != group[x]) & (5 * size >= 4 * size[x]) & (4 * size <= 5 * size[x])
        fits[: x + 1] = False
        if side[x] < 2:
            fits &= side != side[x]
        if not fits.any():
            continue
        s = sets[x]
        at = np.searchsorted(lists, s)
        length = stops[at] - starts[at]
        need = least_overlap(len(s))
        longest = int(length.max())
        skip = min(need - 1, int(need / (0.0085 * math.log2(longest) + 1))) if longest > 1 else 0
        by = np.argsort(length, kind="stable")
        short, long = at[by[: len(s) - skip]], at[by[len(s) - skip :]]
        # Merge the short lists; those with x alone give nothing.
        merged = [owner[starts[k] : stops[k]] for k in short[stops[short] - starts[short] > 1]]
        merged = [x for x in (y[fits[y]] for y in merged) if len(x)]
        for y, shared in merge_lists(merged) if merged else ():
            if shared < need - skip or group[y] == group[x]:
                continue
            if len(long):
                asked = long * m + y
                shared += int((places[np.minimum(np.searchsorted(places, asked), len(places) - 1)] == asked).sum())
            if linked(shared, len(s), len(sets[y])):
                out.append((int(keys[x]), int(keys[y])))
                group[group == group[y]] = group[x]
    return out


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (task, side, key, component, blob), sorted by task: links."""
    task, rows = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        side, key, component, sets = zip(*rows, strict=True)
        if links := divide_skip(np.array(key), list(sets), np.array(side), np.array(component)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])

    for batch in batches:
        for t, side, key, component, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if t != task:
                yield from flush()
                task, rows = t, []
            rows.append((side, key, component, np.frombuffer(blob, np.uint64)))
    yield from flush()


# --------------------------------------------------------------------------- the join


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: float = HOT, block: int = BLOCK, exact: bool = False) -> DataFrame:
    """identifier, n_shingles and component_id (the smallest identifier reachable by links) of every row."""
    spark = docs.sparkSession
    parts = partitions(spark)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    profile = stage(texts.mapInArrow(tidy(_profile), "doc long, key long, n int, long boolean"), "near-profile")
    rows = profile.filter("NOT long").select("doc", "key", "n")
    classes = stage(rows.filter("doc IS NOT NULL AND n > 0").groupBy("key").agg(F.min("doc").alias("rep"), F.min("n").alias("n"), F.count(F.lit(1)).alias("copies")), "near-classes")

    size = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col("n").cast("long")), F.lit(0)).alias("shingles")).first()
    total = size["rows"]
    floor = max(16.0, hot * total / 3, size["shingles"] / LONG_LISTS)
    long = profile.filter("long").groupBy("key").agg(F.sum("n").alias("df")).filter(F.col("df") >= floor)
    found = sorted((r["df"], r["key"]) for r in long.collect())
    tokens = np.array([k for _, k in found], np.int64).view(np.uint64)
    by = np.argsort(tokens)
    lists = spark.sparkContext.broadcast((tokens[by], by.astype(np.int32)))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long_tokens, rank = lists.value
        seen: set[int] = set()
        for batch in batches:
            for lo, hi, buf, offs in text_chunks(batch, "text"):
                token, key, n, words = [], [], [], []
                valid = batch.column(0).slice(lo, hi - lo).is_valid().to_pylist()
                for s, ok in zip(shingle_sets(buf, offs), valid, strict=True):
                    k = set_key(s)
                    if not ok or not k or k in seen:
                        continue
                    seen.add(k)
                    token.append(prefix(s, long_tokens, rank))
                    words.append(sketch(s).view(np.int64))
                    key.append(k)
                    n.append(len(s))
                if len(seen) > 1_000_000:
                    seen.clear()
                if token:
                    times = [len(t) for t in token]
                    lines = [np.concatenate(token).view(np.int64), *(np.repeat(np.array(x, k), times) for x, k in ((key, np.int64), (n, np.int32), *((w, np.int64) for w in zip(*words, strict=True))))]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in lines], names=["token", "key", "n", "s0", "s1"])

    index = texts.mapInArrow(tidy(indexed), "token long, key long, n int, s0 long, s1 long").repartition(parts, "token").sortWithinPartitions("token", "n", "key")
    family = components(index.mapInArrow(tidy(_joined(exact)), "a long, b long").distinct())
    verified = stage(_verified(texts, family, classes, block, parts), "near-links")
    # Rows that share an identifier: their sets are linked, and rows without words take part in what the others are linked to.
    named = rows.filter("doc IS NOT NULL")
    several = stage(named.groupBy("doc").agg(F.min("key").alias("_a"), F.max("key").alias("_b")).filter("_a <> _b").select("doc"), "near-several")
    mates = named.filter("n > 0").join(several, "doc").select("doc", "key")
    mates = mates.join(mates.groupBy("doc").agg(F.min("key").alias("a")), "doc").select("doc", "a", F.col("key").alias("b")).distinct()
    mates = stage(mates, "near-mates")
    links = components(verified.unionAll(mates.filter("a <> b").select("a", "b")))

    least = links.join(classes, links.node == classes.key).groupBy("root").agg(F.min("rep").alias("least"))
    moved = links.join(least, "root").select(F.col("node").alias("key"), "least")
    final = classes.select("key", "rep", "copies").join(moved, "key", "left").select("key", "copies", F.coalesce("least", "rep").alias("component"))
    # Sets that many documents have, of which there can be 4 a partition at most, don't take part in the shuffle.
    often = F.col("copies") >= max(2.0, total / (4 * parts))
    common = rows.join(F.broadcast(final.filter(often).select("key", F.col("component").alias("known"))), "key", "left")
    found = common.filter("known IS NOT NULL").withColumnRenamed("known", "component").unionByName(
        common.filter("known IS NULL").drop("known").join(final.filter(~often).select("key", "component"), "key", "left")
    )
    worded = found.filter("n > 0").select("doc", "n", F.when(F.col("doc").isNotNull(), F.col("component")).alias("component"))
    lent = mates.select("doc", F.col("a").alias("key")).distinct().join(final, "key").select(F.col("doc").alias("_doc"), F.col("component").alias("_lent"))
    blank = rows.filter("n = 0").join(lent, F.col("doc") == F.col("_doc"), "left").select("doc", "n", F.coalesce("_lent", "doc").alias("component"))
    both = worded.unionAll(blank)
    return both.select(F.col("doc").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


def _blocks(sets: Column, block: int) -> Column:
    """How many blocks a group of sets takes: ``sets`` is the shingles of each."""
    return F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(block), F.sum(sets) / F.lit(float(SHINGLES)))).cast("int")


def _verified(texts: DataFrame, family: DataFrame, classes: DataFrame, block: int, parts: int) -> DataFrame:
    """Links inside families, enough to connect all that is linked."""
    member = family.select(F.col("node").alias("key"), F.col("root").alias("fam")).join(classes.select("key", "rep", "n"), "key")
    step = F.log("n") / F.lit(_BAND)
    member = stage(member.withColumn("band", F.floor(step).cast("int")).withColumn("half", F.floor(step + 0.5).cast("int")), "near-members")
    large = stage(member.groupBy("fam").agg(_blocks(F.col("n"), block).alias("subs")).filter("subs > 1").select("fam"), "near-large")
    task = lambda *by: F.struct(F.xxhash64(*by).alias("task"), F.lit(2).alias("side"))
    whole = member.join(large, "fam", "left_anti").select("key", "rep", F.lit(False).alias("large"), F.array(task("fam")).alias("tasks"))
    if large.isEmpty():
        return _searched(_sets(texts, whole).withColumn("component", F.col("key")), parts)
    own = member.join(large, "fam")
    dealt = own
    for name in ("band", "half"):
        subs = own.groupBy("fam", name).agg(_blocks(F.col("n"), block).alias(f"{name}_subs"))
        dealt = dealt.join(subs, ["fam", name])
    place = lambda name: task(F.lit(name), "fam", name, F.pmod(F.xxhash64("key", F.lit(name)), F.col(f"{name}_subs")))
    dealt = dealt.select("key", "rep", F.lit(True).alias("large"), F.array(place("band"), place("half")).alias("tasks"))
    sets = stage(_sets(texts, whole.unionAll(dealt)), "near-sets")
    links = stage(_searched(sets.withColumn("component", F.col("key")), parts), "near-dealt")

    known = components(links).select(F.col("node").alias("key"), "root")
    own = own.join(known, "key", "left").withColumn("component", F.coalesce("root", "key")).drop("root")
    sizes = stage(own.groupBy("fam", "component").agg(F.count(F.lit(1)).alias("in")), "near-parts")
    unsettled = sizes.groupBy("fam").agg(F.count(F.lit(1)).alias("components")).filter("components > 1").select("fam")
    # Members of components of half a block or more are dealt apart from the others, so that blocks of one component can be left out.
    own = own.join(unsettled, "fam").join(sizes, ["fam", "component"]).withColumn("part", F.when(F.col("in") * 2 >= block, F.col("component")).otherwise(F.lit(0)))
    own = stage(own.drop("in", "half"), "near-unsettled")
    if own.isEmpty():
        return links
    cells = own.groupBy("fam", "band", "part").agg(_blocks(F.col("n"), block).alias("subs"))
    mine = own.join(cells, ["fam", "band", "part"]).withColumn("sub", F.pmod(F.xxhash64("key"), F.col("subs")).cast("int"))
    near = cells.select("fam", F.col("band").alias("oband"), F.col("part").alias("opart"), F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("osub"))
    around = mine.withColumn("oband", F.explode(F.array(*[F.col("band") + d for d in range(-2, 3)]))).join(near, ["fam", "oband"]).filter("part <> opart OR part = 0")
    here = F.struct("band", "part", "sub")
    there = F.struct(F.col("oband").alias("band"), F.col("opart").alias("part"), F.col("osub").alias("sub"))
    across = around.select(
        "key",
        "component",
        F.struct(F.xxhash64("fam", F.least(here, there), F.greatest(here, there)).alias("task"), F.when(here == there, 2).when(here < there, 0).otherwise(1).alias("side")).alias("t"),
    )
    across = across.groupBy("key", "component").agg(F.collect_list("t").alias("tasks"))
    return links.unionAll(_searched(sets.filter("large").select("key", "blob").join(across, "key"), parts))


def _sets(texts: DataFrame, plan: DataFrame) -> DataFrame:
    """(key, tasks, large, blob): the sets that are asked for, from their texts. Neither side is small, so none is broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in text_chunks(batch, "text"):
                sets = shingle_sets(buf, offs)
                part = batch.slice(lo, hi - lo)
                same = pa.array([set_key(s) == k for s, k in zip(sets, part.column(1).to_pylist(), strict=True)])
                out = pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "tasks", "large", "blob"])
                yield out.filter(same)

    wanted = texts.join(plan.withColumnRenamed("rep", "doc").hint("merge"), "doc").select("text", "key", "tasks", "large")
    return wanted.mapInArrow(tidy(run), "key long, tasks array<struct<task:long,side:int>>, large boolean, blob binary")


def _searched(sets: DataFrame, parts: int) -> DataFrame:
    """Links of the blocks that the sets (key, component, tasks, blob) are dealt to."""
    dealt = sets.select(F.explode("tasks").alias("t"), "key", "component", "blob").select("t.task", "t.side", "key", "component", "blob")
    return dealt.repartition(parts, "task").sortWithinPartitions("task", "key").mapInArrow(tidy(_search), "a long, b long")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose identifier is the smallest of its component; rows with a null identifier stay."""
    found = near_duplicates(docs, id_col, text_col, **options)
    gone = found.filter(f"`{id_col}` <> component_id").select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
