"""Each operator against a plain version of its contract, on real rows and on awkward ones."""

import collections
import random
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from larkspur.llm import exact_dedup, line_crf, mixing, near_dup, packing, pii, quality_rules, sharding, substring_dedup, wavelet
from tests.compare import both, connect
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, `keep_id` string, text_sha256 string"
WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud".split()


def prose(seed, n):
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x // 65536 % len(WORDS)] + str(x // 256 % 89))
    return " ".join(out)


LONG = prose(5, 30_000)
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Two words"), (6, prose(1, 200)), (7, prose(1, 200).upper()), (8, prose(1, 195)), (9, LONG), (10, LONG + " more"), (11, "a b  c\x0bd\r\n e"),
    (12, "ÀÉ straße ÀÉ"), (13, "àé straße ÀÉ"), (14, "x" * 5000), (15, "1" * 3000), (16, prose(2, 80) + " " + prose(3, 60)), (17, prose(4, 30) + " " + prose(3, 60) + " " + prose(6, 30)), (18, "mail me.now@ex-ample.co.uk, +1 (555) 555-0199 4111 1111 1111 1111 10.0.0.256 10.0.0.255"),
    (6, prose(1, 200)), (19, "\n".join(["same line here"] * 50)), (20, "the " * 80), (21, "and the " * 60 + "the " * 90), (None, prose(9, 40)), (22, "<|endoftext|> a <|endoftext|>"), (-3, "negative"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "en", None if i and i % 4 == 0 else f"s{(i or 0) % 3}", len(t or ""), "clash", "clash", "clash") for i, t in AWKWARD]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(data):
    t = pq.read_table(f"{data}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], t["text"], strict=True))


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op2_sharding", "op10_mixing"])
def test_matches_sql(spark, data, name):
    got, want = both(connect(data), entry.queries()[name](spark, data), entry.oracle_sql()[name])
    assert got == want


# --------------------------------------------------------------------------- exact copies


def test_exact_copies_of_awkward_rows(awkward):
    rows = exact_dedup.exact_groups(awkward, keep="max").collect()
    groups = collections.defaultdict(list)
    for i, t in AWKWARD:
        groups[brute.lower(t)].append(i)
    want = {brute.sha(t): (max([i for i in ids if i is not None], default=None), len(ids)) for t, ids in groups.items()}
    assert len(rows) == len(AWKWARD)
    assert all(want[r.text_sha256] == (r.keep_id, r.group_size) for r in rows)
    assert collections.Counter(r.text_sha256 for r in rows if r.kept) == collections.Counter(list(want))
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_smallest_identifier_may_stay_instead(awkward):
    rows = exact_dedup.exact_groups(awkward, keep="min").collect()
    assert {r.keep_id for r in rows if r.doc_id in (1, 2)} == {1}


def test_dropping_copies_keeps_columns(awkward, empty):
    kept = exact_dedup.drop_exact_copies(awkward)
    assert kept.columns == awkward.columns
    assert sorted(brute.lower(r.text) for r in kept.collect()) == sorted({brute.lower(t) for _, t in AWKWARD})
    assert exact_dedup.drop_exact_copies(empty).count() == 0 and exact_dedup.exact_groups(empty).count() == 0


def test_hot_group_is_whole(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Hot Text").otherwise(F.col("id").cast("string")).alias("text"))
    rows = exact_dedup.exact_groups(docs).filter("group_size > 1").collect()
    assert len(rows) == 1000 and {(r.keep_id, r.group_size) for r in rows} == {(2997, 1000)} and sum(r.kept for r in rows) == 1


# --------------------------------------------------------------------------- shards


def test_shards_hold_every_row_once(spark, awkward, empty, tmp_path):
    table = sharding.ShardTable(spark, f"file://{tmp_path}/t", awkward.schema, target_bytes=1 << 20, fanout=3, base_bytes=1 << 12)
    for _ in range(3):
        table.append(awkward, 4)
    before = len(table.manifest())
    table.append(empty)
    version = table.compact()
    assert version == table.versions()[-1] and len(table.manifest()) < before
    assert not table.plan(table.manifest())
    key = lambda r: (str(r.doc_id), r.text or "", r.text is None)
    assert sorted(map(key, table.read().collect())) == sorted(map(key, awkward.collect() * 3))
    assert table.read().columns == awkward.columns


def test_two_writers_cannot_commit_one_version(spark, awkward, tmp_path):
    table = sharding.ShardTable(spark, f"file://{tmp_path}/t", awkward.schema)
    table.append(awkward)
    with pytest.raises(RuntimeError, match="another writer"):
        table.commit([], set(), 0)
    with pytest.raises(ValueError, match="no committed version"):
        sharding.ShardTable(spark, f"file://{tmp_path}/none", awkward.schema).read()


def test_compaction_ends_however_small_scans_are(spark, awkward, tmp_path):
    old = {k: spark.conf.get(f"spark.sql.files.{k}", None) for k in ("maxPartitionBytes", "openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        table = sharding.ShardTable(spark, f"file://{tmp_path}/t", awkward.schema)
        table.append(awkward, 1)
        table.compact()
        assert len(table.manifest()) == 1 and table.read().count() == len(AWKWARD)
    finally:
        for k, v in old.items():
            spark.conf.unset(f"spark.sql.files.{k}") if v is None else spark.conf.set(f"spark.sql.files.{k}", v)


def test_of_two_threads_one_commits(spark, awkward, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    tables = [sharding.ShardTable(spark, f"file://{tmp_path}/t", awkward.schema) for _ in range(8)]
    tables[0].append(awkward)

    def attempt(table):
        try:
            return table.commit([], set(), 1)
        except RuntimeError:
            return None

    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(attempt, tables))
    assert sorted(map(str, got)) == ["2", *["None"] * 7] and tables[0].versions() == [1, 2]
    assert tables[0].read().count() == len(AWKWARD)


def test_vacuum_leaves_what_others_are_writing(spark, awkward, tmp_path):
    one, two = (sharding.ShardTable(spark, f"file://{tmp_path}/t", awkward.schema, target_bytes=1 << 20, fanout=2, base_bytes=1 << 12) for _ in range(2))
    one.append(awkward, 4)
    with two._folder() as folder:
        awkward.write.parquet(folder)
        one.compact()
        one.vacuum(grace=0.0)
        shards = two._listed(folder)
        two.commit(shards, set(), two.latest())
    assert two.read().count() == 2 * len(AWKWARD) and set(shards) < set(one.manifest())
    files = {p for p in (tmp_path / "t").glob("shards-*/*.parquet")}
    two.vacuum()
    assert {p for p in (tmp_path / "t").glob("shards-*/*.parquet")} == files
    old = tmp_path / "t" / "shards-left"
    awkward.write.parquet(f"file://{old}")
    reader = one.read()
    two.vacuum(grace=3600.0)
    assert old.exists()
    two.vacuum(grace=0.0)
    assert not old.exists() and reader.count() == one.read().count() == 2 * len(AWKWARD)


def test_unfinished_versions_are_passed_over(spark, awkward, tmp_path):
    table = sharding.ShardTable(spark, f"file://{tmp_path}/t", awkward.schema)
    table.append(awkward)
    (tmp_path / "t" / "_manifests" / "v00000002").write_text("part-1")
    assert table.versions() == [1] and table.read().count() == len(AWKWARD)
    assert table.append(awkward) == 3 and table.versions() == [1, 3] and table.read().count() == 2 * len(AWKWARD)


def test_commits_write_the_parts_that_change(spark, awkward, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "PART_LINES", 4)
    table = sharding.ShardTable(spark, f"file://{tmp_path}/t", awkward.schema)
    table.append(awkward, 2)
    first = set(table._parts(1))
    table.append(awkward, 2)
    assert len(first) > 2 and len(first & set(table._parts(2))) >= len(first) - 1
    assert table.read().count() == 2 * len(AWKWARD) and table.read(1).count() == len(AWKWARD)


# --------------------------------------------------------------------------- repeated passages


def test_passages_are_found(spark, awkward, empty):
    rows = substring_dedup.repeated_passages(awkward).collect()
    pairs = {(r.doc_id, r.ref_doc_id) for r in rows}
    assert {(7, 6), (8, 6), (10, 9), (17, 16)} <= pairs
    part = next(r for r in rows if (r.doc_id, r.ref_doc_id) == (17, 16))
    assert part.n_words >= 60 and abs(part.start_word - 30) <= 2 and part.identity > 0.9
    assert not {r.doc_id for r in rows} & {1, 2, 3, 4, 5, 11, 12, 13, 14, 15, 18}
    assert all(r.ref_doc_id < r.doc_id for r in rows)
    assert (21, 20) in pairs  # one word over and over
    assert substring_dedup.repeated_passages(empty).count() == 0


def test_fuzzy_passage_and_cut(spark):
    words = prose(11, 120).split()
    changed = [w if i % 25 else "changed" for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, prose(12, 40) + " " + " ".join(words)), (2, " ".join(changed) + " " + prose(13, 40))], "doc_id long, text string")
    row = substring_dedup.repeated_passages(docs).first()
    assert row.doc_id == 2 and row.matched >= 100
    left = {r.doc_id: r.text for r in substring_dedup.cut_repeats(docs).collect()}
    assert left[1] == docs.filter("doc_id = 1").first().text and len(left[2].split()) <= 50 and prose(13, 40) in left[2]


def test_passages_with_own_text_between(spark):
    one, two = prose(31, 60), prose(32, 60)
    texts = [(1, one, 33, 100, two), (2, one, 34, 100, two), (3, one, 35, 130, two)]
    docs = spark.createDataFrame([(i, f"{a} {prose(seed, n)} {b}") for i, a, seed, n, b in texts], "doc_id long, text string")
    found = {}
    for r in substring_dedup.repeated_passages(docs).collect():
        assert r.matched >= 50 and r.identity >= 0.8
        found.setdefault((r.doc_id, r.ref_doc_id), set()).update(range(r.start_word, r.start_word + r.n_words))
    for i, n in ((2, 100), (3, 130)):
        assert {*range(60), *range(60 + n, 120 + n)} <= found[i, 1]
        assert len(found[i, 1]) <= 150


def test_passages_of_which_others_have_parts(spark):
    long = prose(42, 100).split()
    docs = {1001 + i: long[10 * i : 10 * i + 30] for i in range(8)} | {1100: long} | {1150 + i: long[10 * i : 10 * i + 30] for i in range(8)} | {1200: long}
    rows = [(i, f"{prose(i + 500, 30)} {' '.join(w)} {prose(i + 3000, 30)}") for i, w in docs.items()]
    for ordered in (sorted(rows), sorted(rows)[::-1]):
        df = spark.createDataFrame(ordered, "doc_id long, text string")
        for parts in (1, 5):
            found = {(r.doc_id, r.ref_doc_id) for r in substring_dedup.repeated_passages(df.coalesce(1) if parts == 1 else df.repartition(parts)).collect()}
            assert (1200, 1100) in found


def test_a_seed_leads_to_the_document_before(spark):
    words = prose(41, 60).split()
    docs = [(1, words[:35]), (2, words[26:]), (100, words), (200, words)]
    df = spark.createDataFrame([(i, f"{prose(i + 500, 30)} {' '.join(w)} {prose(i + 3000, 30)}") for i, w in docs], "doc_id long, text string")
    for parts in (1, 4):
        assert {(r.doc_id, r.ref_doc_id) for r in substring_dedup.repeated_passages(df.repartition(parts)).collect()} == {(200, 100)}


def test_real_passages(spark, data, documents):
    found = {r.doc_id for r in entry.queries()["op3_substring_dedup"](spark, data).collect()}
    first, shared = {}, set()
    for i in sorted(documents):
        w = brute.WORD.findall(brute.lower(documents[i]))
        for k in range(len(w) - 69):
            if first.setdefault(tuple(w[k : k + 70]), i) != i:
                shared.add(i)
    assert shared and shared <= found


def _passages(docs, **options):
    return sorted(map(tuple, substring_dedup.repeated_passages(docs, **options).collect()))


@pytest.mark.parametrize("run,own", [(200, 150), (1500, 900)])
def test_long_passages_around_own_text(spark, run, own):
    one, two = prose(61, run), prose(62, run)
    docs = spark.createDataFrame([(i, f"{one} {prose(63 + i, own - 50 * i)} {two}") for i in (1, 2)], "doc_id long, text string")
    found = set()
    for r in substring_dedup.repeated_passages(docs).collect():
        assert r.identity >= 0.8
        found.update(range(r.start_word, r.start_word + r.n_words))
    gap = own - 100
    assert {*range(run), *range(run + gap, 2 * run + gap)} <= found and len(found) <= 2 * run + 60


def test_passages_do_not_depend_on_partitions(spark, documents):
    rows = [*documents.items(), *((i, f"{prose(i, 20)} {prose(70, 60)}") for i in (10_001, 10_050, 10_060))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = _passages(docs.repartition(8), hot=4)
    assert {(10_050, 10_001), (10_060, 10_001)} <= {(r[0], r[3]) for r in want}
    assert _passages(docs.coalesce(1), hot=4) == want and _passages(docs.repartition(64), hot=4) == want
    assert {r[0] for r in _passages(docs)} == {r[0] for r in want}


def test_passages_against_plain_alignment(documents, spark):
    docs = spark.createDataFrame(list(documents.items()), "doc_id long, text string")
    words = {i: brute.WORD.findall(brute.lower(t)) for i, t in documents.items()}
    found = substring_dedup.repeated_passages(docs).collect()
    for r in found:
        x, y = words[r.doc_id][r.start_word :][: r.n_words], words[r.ref_doc_id][r.ref_start_word :][: r.ref_n_words]
        assert len(x) == r.n_words and len(y) == r.ref_n_words and r.ref_doc_id < r.doc_id
        assert 50 <= r.matched <= brute.in_order(x, y) and r.identity == pytest.approx(r.matched / max(len(x), len(y))) and r.identity >= 0.8
    shared = brute.exact_runs(words, 50)
    covered = collections.defaultdict(set)
    for r in found:
        covered[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
    hit = sum(k in covered[i] for i, places in shared.items() for k in places)
    assert shared and set(shared) <= set(covered) and hit >= 0.99 * sum(map(len, shared.values()))


@pytest.mark.parametrize("hot", [4, substring_dedup.HOT])
def test_every_exact_run_of_fifty_words(spark, hot):
    rng = random.Random(5)
    base, rows = prose(91, 1200).split(), {}
    for i in range(1, 161):
        w = []
        for _ in range(rng.randrange(1, 5)):
            a = rng.randrange(1100)
            w += [f"own{rng.randrange(10**6)}" for _ in range(rng.randrange(40))] + base[a : a + rng.choice([49, 50, 51, 53, 57, 63, 70])]
            w += ["again"] * rng.choice([0, 0, 0, 40, 50, 60, 120]) + ["to", "and", "fro"] * rng.choice([0, 0, 17, 25])
        rows[i] = w
    found = substring_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string").repartition(6), hot=hot).collect()
    covered = collections.defaultdict(set)
    for r in found:
        covered[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
    shared = brute.exact_runs(rows, 50)
    assert len(shared) > 100 and all(places <= covered[i] for i, places in shared.items())


def test_words_in_order_of_long_gaps(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.permutation(3000)
    y = np.where(rng.random(3000) < 0.3, 5000 + np.arange(3000), x)
    want = substring_dedup._edit_matches(x, y)
    monkeypatch.setattr(substring_dedup, "CELLS", 1000)
    assert substring_dedup._edit_matches(x, y) == want == int((x == y).sum())


def test_cutting_rows_that_share_an_identifier(spark):
    text = prose(81, 120)
    rows = [(1, text, "a", "b"), (2, "short", "a", "b"), (2, f"{prose(82, 30)} {text}", "a", "b"), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _doc string, _spans string")
    out = substring_dedup.cut_repeats(docs)
    got = sorted((r.doc_id, r.text or "", r._doc) for r in out.collect())
    assert out.columns == docs.columns and [g[0] for g in got] == [1, 2, 2, 3]
    assert got[0][1] == text and got[2][1] == "short" and got[1][1].split() == prose(82, 30).split()


def test_chains_prefer_order():
    got = substring_dedup.chains([0, 10, 20, 30], [100, 110, 5, 130])
    assert got[0] == [0, 1, 3] and len(got) == 1


# --------------------------------------------------------------------------- near copies


def test_near_copies_match_all_pairs(spark, data, documents):
    want = brute.near_components(documents)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in entry.queries()["op4_near_duplicates"](spark, data).collect()}
    assert got == want


def test_near_copies_of_awkward_rows(awkward, empty):
    texts = {i: t for i, t in AWKWARD if i is not None}
    want = brute.near_components(texts)
    rows = near_dup.near_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == want
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert near_dup.near_duplicates(empty).count() == 0
    kept = near_dup.keep_one(awkward)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} == {c for _, c in want.values()} | {None}


def test_large_family_in_blocks(spark):
    words = prose(21, 150).split()
    texts = {i: " ".join(w if (k * 31 + i) % 149 or i % 3 == 0 else f"w{i}" for k, w in enumerate(words[: 150 - i % 7])) for i in range(400)}
    texts |= {i: " ".join([*words[:90], *prose(i, 60).split()]) for i in range(400, 460)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute.near_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, block=64).collect()}
    assert got == want


def _nodes(rows):
    return {(r.doc_id, r.n_shingles): r.component_id for r in rows}


def test_rows_that_share_an_identifier_are_one_node(spark):
    a, b = prose(91, 100), prose(92, 100)
    rows = [(1, a), (5, a + " tail"), (5, b), (9, b + " tail"), (5, ""), (7, ""), (7, None), (8, prose(93, 40)), (8, prose(94, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == {1: 1, 5: 1, 9: 1, 7: 7, 8: 8}
    assert len({(r.doc_id, r.component_id) for r in got}) == 5
    assert sorted(r.doc_id for r in near_dup.keep_one(docs).collect()) == [1, 7, 7, 8, 8]


@pytest.mark.parametrize("exact", [True, False])
def test_large_family_of_several_components(spark, exact):
    """Texts of one template: clusters that link within, and others near them that link with nothing."""
    base, texts = prose(95, 200).split(), {}
    for i in range(240):
        c = i % 4
        own = [*base[: 130 + 5 * (i % 3)], *prose(200 + c, 60).split()] if i % 5 else [*base[:120], *prose(300 + i, 70).split()]
        texts[i] = " ".join(w if k != (7 * i) % len(own) else f"x{i}" for k, w in enumerate(own))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute.near_components(texts)
    assert 4 <= len({c for _, c in want.values()}) < 120
    for block in (16, 1000):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, block=block, exact=exact).collect()}
        assert got == want


def test_blocks_are_bounded_by_size_too(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SHINGLES", 600)
    texts = {i: " ".join(w if k != i else f"x{i}" for k, w in enumerate(prose(96, 150).split())) for i in range(60)}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute.near_components(texts)


@pytest.mark.parametrize("heap", [0, 50, 10**6])
def test_divide_skip_links_what_all_pairs_link(monkeypatch, heap):
    import numpy as np

    monkeypatch.setattr(near_dup, "HEAP", heap)
    rng = np.random.default_rng(4)
    cores = [rng.integers(0, 2**63, 60, dtype=np.uint64) for _ in range(6)]
    sets = [np.unique(np.append(rng.choice(cores[i % 6], 57, replace=False), rng.integers(0, 2**63, rng.integers(1, 7), dtype=np.uint64))) for i in range(80)]
    root = list(range(80))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def groups(links):
        root[:] = range(80)
        for a, b in links:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return [find(i) for i in range(80)]

    pairs = [(i, j) for i in range(80) for j in range(i) if near_dup.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))]
    got = near_dup.divide_skip(np.arange(80), sets, np.full(80, 2), np.arange(80))
    assert {tuple(sorted(x, reverse=True)) for x in got} <= set(pairs) and groups(got) == groups(pairs) and len(pairs) > 100


# --------------------------------------------------------------------------- packing and token files


@pytest.mark.parametrize("real", [True, False])
def test_packing_covers_every_id(spark, data, documents, awkward, empty, real):
    rows = list(documents.items()) if real else AWKWARD
    pieces = (entry.queries()["op5_packing"](spark, data) if real else packing.pack(awkward)).collect()
    ids = brute.token_ids([t for _, t in rows], "word_bpe_49k.json")
    want = collections.Counter()
    for (i, _), x in zip(rows, ids, strict=True):
        at = 0
        for power in [4096] * (len(x) // 4096) + [1 << b for b in range(11, -1, -1) if len(x) % 4096 >> b & 1]:
            want[i, at, power, brute.crc(x[at : at + power]), len(x)] += 1
            at += power
    assert collections.Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == want
    assert len({p.sequence_id for p in pieces}) == len(pieces) and {p.offset for p in pieces} == {0}
    assert packing.pack(empty).count() == 0


def test_buckets_on_disk(spark, awkward, tmp_path):
    packing.write_buckets(awkward, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.filter(F.octet_length("ids") != 4 * F.col("bucket")).count() == 0


@pytest.mark.parametrize("real", [True, False])
def test_token_files_round_trip(spark, data, documents, awkward, tmp_path, real):
    rows = list(documents.items()) if real else AWKWARD
    if real:
        got = entry.queries()["op8_token_output"](spark, data).collect()
    else:
        wavelet.write_shards(awkward, str(tmp_path / "w"), shard_tokens=2000)
        got = wavelet.documents_of(spark, str(tmp_path / "w")).collect()
    ids = brute.token_ids([t for _, t in rows], "byte_bpe_50k.json")
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == collections.Counter((i, len(x), brute.crc(x)) for (i, _), x in zip(rows, ids, strict=True))
    at = 0
    order = sorted(got, key=lambda r: r.start)
    for r in order:
        assert r.start == at
        at += r.n_tokens
    keys = [r.doc_id for r in order]
    assert keys == sorted(keys, key=lambda x: (x is not None, x or 0))


def test_rank_select_and_counts(spark, awkward, empty, tmp_path):
    import numpy as np

    x = np.random.default_rng(3).integers(0, 900, 20_000)
    m = wavelet.WaveletMatrix.build(x, 10)
    assert (m.decode() == x).all() and all(m.access(i) == x[i] for i in (0, 4095, 4096, 12_345, 19_999))
    for t in (0, 17, 899):
        places = np.flatnonzero(x == t)
        assert m.rank(t) == len(places) and m.rank(t, 10_000) == (places < 10_000).sum()
        assert [m.select(t, k) for k in range(len(places))] == places.tolist()
    assert m.rank(2000) == 0
    with pytest.raises(IndexError):
        m.select(0, 10**6)
    wavelet.write_shards(awkward, str(tmp_path / "w"), shard_tokens=2000)
    ends = wavelet.occurrences(spark, str(tmp_path / "w"), 2).collect()
    assert sum(r.n for r in ends) == len(AWKWARD)
    assert sorted(p for r in ends for p in r.positions) == sorted(r.start + r.n_tokens - 1 for r in wavelet.documents_of(spark, str(tmp_path / "w")).collect())
    wavelet.write_shards(empty, str(tmp_path / "e"))
    assert wavelet.documents_of(spark, str(tmp_path / "e")).count() == 0


# --------------------------------------------------------------------------- trained quality


def test_classifier_is_accurate_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in entry.queries()["op6_quality_classifier"](spark, folder).collect()}
    t = pq.read_table(f"{folder}/labels.parquet").to_pydict()
    held = [(q, rows[i]) for i, q in zip(t["doc_id"], t["quality"], strict=True) if q is not None and zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out for _, r in held) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    assert sum(q == r.predicted for q, r in held) >= 0.95 * len(held)


def test_classifier_on_awkward_rows(spark, awkward, empty, no_labels):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(4, 21)] + [(4, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    for model in (line_crf.fit(awkward, labels), line_crf.fit(awkward, no_labels), line_crf.fit(empty, labels)):
        rows = line_crf.score(awkward, model).collect()
        assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
        assert line_crf.score(empty, model).count() == 0
        assert line_crf.drop_low_quality(awkward, model).columns == awkward.columns


def test_forward_backward_by_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    score, trans, doc = rng.normal(size=(6, 2)), rng.normal(size=(2, 2)), np.array([0, 0, 0, 1, 2, 2])
    good, expected, z = line_crf.marginals(score, doc, trans)
    want, pairs, total = np.zeros(6), np.zeros((2, 2)), 0.0
    for d in range(3):
        at = np.flatnonzero(doc == d)
        paths = list(itertools.product((0, 1), repeat=len(at)))
        w = np.exp([sum(score[i, y] for i, y in zip(at, p, strict=True)) + sum(trans[a, b] for a, b in itertools.pairwise(p)) for p in paths])
        total += np.log(w.sum())
        for p, v in zip(paths, w / w.sum(), strict=True):
            want[at] += v * np.array(p)
            for a, b in itertools.pairwise(p):
                pairs[a, b] += v
    assert np.allclose(good, want) and np.allclose(expected, pairs) and np.isclose(z, total)


@pytest.mark.parametrize("label", [0, 1])
def test_classifier_with_labels_of_one_kind_learns_nothing(spark, awkward, label):
    labels = spark.createDataFrame([(i, label) for i in range(1, 25)], "doc_id long, quality int")
    model = line_crf.fit(awkward, labels)
    assert model is line_crf.NEUTRAL
    assert {r.score for r in line_crf.score(awkward, model).collect()} == {0.5}
    assert line_crf.drop_low_quality(awkward, model).count() == len(AWKWARD)


@pytest.mark.parametrize("real", [True, False])
def test_quality_rules_count_as_worded(spark, data, documents, awkward, no_labels, real):
    rows = list(documents.items()) if real else AWKWARD
    got = (entry.queries()["op9_quality_rules"](spark, data) if real else quality_rules.judge(awkward, quality_rules.fit(awkward, no_labels))).collect()
    shape = lambda r: (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
    assert collections.Counter(map(shape, got)) == collections.Counter((i, *brute.rules(t)) for i, t in rows)
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_rules_are_accurate_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in entry.queries()["op9_quality_rules"](spark, folder).collect()}
    t = pq.read_table(f"{folder}/labels.parquet").to_pydict()
    held = [(q, rows[i]) for i, q in zip(t["doc_id"], t["quality"], strict=True) if q is not None and zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(q == int(r.kept) for q, r in held) >= 0.9 * len(held)


# --------------------------------------------------------------------------- personal data


@pytest.mark.parametrize("real", [True, False])
def test_personal_data_as_worded(spark, data, documents, awkward, empty, real):
    rows = list(documents.items()) if real else AWKWARD
    got = (entry.queries()["op7_pii"](spark, data) if real else pii.find(awkward)).collect()
    want = collections.Counter()
    for i, t in rows:
        f = brute.personal(t)
        want[(i, *(len(f[k]) for k in ("email", "ip", "card", "phone")), brute.sha(brute.personal_text(f)))] += 1
    assert collections.Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    assert all(brute.sha(r.spans) == r.base_sha256 for r in got if not r.n_added)
    assert pii.find(empty).count() == 0


def test_patterns_discover_other_spellings(spark):
    seeds = [(i, f"please call me at +1 (555) 555-01{i:02d} today") for i in range(12)]
    docs = spark.createDataFrame([*seeds, (50, "please call me at 555-867-5309 today"), (51, "the part number is 555-867-5309 today"), (52, "nothing here")], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find(docs).collect()}
    assert rows[50].n_added == 1 and rows[50].spans == "phone:18:30" and rows[50].n_phone == 0
    assert rows[51].n_added == 0 and rows[52].spans == "" and all(rows[i].n_phone == 1 and rows[i].n_added == 0 for i in range(12))


def _growing():
    """Seeds teach "reach me at"; what is found there teaches "my line is", where no seed ever stands."""
    spaced = [f"555 010 {1000 + i}" for i in range(14)]
    texts = [f"please reach me at +1 (555) 555-01{i:02d} after noon {i}" for i in range(60)]
    texts += [f"please reach me at {p} after dark {i}" for i, p in enumerate(spaced[:8])]
    texts += [f"today my line is {p} as ever {i}" for i, p in enumerate(spaced[2:14])]
    texts += [f"part of list number {2000000 + i} in stock {i}" for i in range(20)] + ["today my line is (555) 010-7777 as of now", "reach me at home", "we reach me at once"]
    texts += [f'the key = "{i:02d}ab56cd78ef90ab12cd34ef56ab78cd90"' for i in range(6)] + ['the key = "short1234x5678yz9"', "no key here"]
    return texts


def _plain_patterns(texts):
    """Accepted patterns by going through all mentions and words again and again."""
    words = [brute.WORD.findall(t) for t in texts]
    flat = lambda w: "".join("0" if c in "0123456789" else c for c in brute.lower(w))
    places, edges = collections.Counter(), collections.defaultdict(collections.Counter)
    for t, ws in zip(texts, words, strict=True):
        pairs = list(zip(map(flat, ws), map(flat, ws[1:]), strict=False))
        places.update(pairs)
        for a, b, k, shape in pii.found_in(t)[1]:
            first, last = len(brute.WORD.findall(t[:a] + "x")) - 1, len(brute.WORD.findall(t[:b])) - 1
            kinds = [k] if k >= 0 else [j for j in range(5) if shape >> j & 1]
            for side, at in ((0, first - 2), (1, last + 1)):
                if 0 <= at < len(pairs):
                    for j in kinds:
                        edges[side, pairs[at], j][brute.lower(t[a:b]), k >= 0] += 1
    known, good = {(x, j) for (_, _, j), e in edges.items() for x, seed in e if seed}, {}
    while True:
        good = {}
        for (side, pair, j), e in edges.items():
            worth = sum(n if (x, j) in known else n / 2 for (x, _), n in e.items())
            if len({x for x, _ in e if (x, j) in known}) >= 5 and worth / places[pair] >= 0.7:
                good[side, pair, j] = worth / places[pair]
        doubt = collections.defaultdict(lambda: 1.0)
        for key, c in good.items():
            for x, seed in edges[key]:
                if not seed:
                    doubt[x, key[2]] *= 1 - c
        new = known | {x for x, d in doubt.items() if 1 - d >= 0.7}
        if new == known:
            return good
        known = new


def test_patterns_grow_from_what_they_find(spark):
    texts = _growing()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.extract(docs, "doc_id", "text")
    good = pii.patterns(rows, docs, "text")
    want = _plain_patterns(texts)
    assert sorted((r.side, r.as_kind, round(r.confidence, 9)) for r in good.collect()) == sorted((s, k, round(c, 9)) for (s, _, k), c in want.items())
    assert {(0, ("me", "at"), 3), (0, ("line", "is"), 3)} <= set(want)
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    for i, t in enumerate(texts):
        hidden = t.startswith("today my line") or "555 010" in t
        assert got[i].n_added == hidden and got[i].n_phone == ("+1" in t), t
        assert got[i].n_secret == ("key =" in t)
        assert got[i].n_found == got[i].n_added + got[i].n_phone + got[i].n_secret
    last = next(i for i, t in enumerate(texts) if "7777" in t)
    assert got[last].spans == f"phone:{texts[last].index('(555)')}:{texts[last].index('7777') + 4}"


def test_contexts_beyond_what_is_sent_along(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(_growing())), "doc_id long, text string")
    want = sorted(map(tuple, pii.find(docs).collect()))
    monkeypatch.setattr(pii, "CONTEXTS", 1)
    assert sorted(map(tuple, pii.find(docs).collect())) == want


@pytest.mark.parametrize("text", ["a@b.c_x@d.e", "x@y", "a@b..c@d.e", "@a.b", "a@@b.c", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "1.2.3.400 1.2.3.4", "+1 +1 (555) 555-0199", "4111-1111-1111-1111 2", "٣.1.2.3.4", "1" * 50])
def test_spans_equal_the_patterns(text):
    want = brute.personal(text)
    got = pii.base_spans(text)
    assert [(pii.KINDS[k], a, b) for a, k, b in got] == sorted(((k, a, b) for k in want for a, b in want[k]), key=lambda x: (x[1], pii.KINDS.index(x[0])))


# --------------------------------------------------------------------------- mixing


def test_mixing_meets_targets(spark, awkward, empty):
    rows = mixing.sample_to_targets(awkward, carry=True).collect()
    assert len(rows) == len(AWKWARD)
    by = collections.defaultdict(list)
    for r in rows:
        by[r._row["source"]].append(r)
        assert r.size == len(brute.WORD.findall(r._row["text"] or "")) and 0 <= r.taken <= 3 * r.size
    for rs in by.values():
        assert sum(r.taken for r in rs) == pytest.approx(rs[0].target, abs=1) and sum(r.size for r in rs) == rs[0].source_size
    assert sum(rs[0].target for rs in by.values()) == pytest.approx(sum(r.size for r in rows))
    assert mixing.sample_to_targets(empty).count() == 0 and mixing.mix_documents(empty).count() == 0
    again = {(r.doc_id, r.size, r.taken) for r in mixing.sample_to_targets(awkward.repartition(5)).collect()}
    assert again == {(r.doc_id, r.size, r.taken) for r in rows}


@pytest.mark.parametrize("identifier", ["NULL", "7", "id % 3", "id", "IF(id % 2 = 0, NULL, 5)"])
@pytest.mark.parametrize("text", ["'ten words ' || id || ' of its own in this short row'", "'the same nine words in each of these rows'"])
def test_mixing_meets_targets_whatever_the_identifiers(spark, identifier, text):
    docs = spark.range(600).selectExpr(f"CAST({identifier} AS long) AS doc_id", f"{text} AS text", "'s' || CASE WHEN id < 60 THEN 0 WHEN id < 200 THEN 1 ELSE 2 END AS source").repartition(5)
    rows = mixing.sample_to_targets(docs, carry=True).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r._row["source"]].append(r)
        assert 0 <= r.taken <= 3 * r.size
    assert sorted(map(len, by.values())) == [60, 140, 400]
    for rs in by.values():
        assert sum(r.taken for r in rs) == pytest.approx(rs[0].target, abs=1)
        assert sum(r.taken % r.size > 0 for r in rs) <= 1
    shape = lambda rows: collections.Counter((r.doc_id, r._row["text"], r.taken) for r in rows)
    assert shape(mixing.sample_to_targets(docs.repartition(2), carry=True).collect()) == shape(rows)


def test_mixture_has_the_words_it_takes(awkward):
    taken = sum(r.taken for r in mixing.sample_to_targets(awkward).collect())
    out = mixing.mix_documents(awkward)
    assert out.columns == awkward.columns
    assert sum(len(brute.WORD.findall(r.text)) for r in out.collect()) == taken


def test_targets_by_water_filling(spark):
    sizes = {"a": 10, "b": 1000, "c": 50, "d": 4000, None: 7, "e": 0}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    weight = dict(zip(["a", "b", "c", "d", "e", None], [5, 2, 1, 5, 2, 1], strict=True))
    left, open_, want = float(sum(sizes.values())), set(sizes), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
            left -= want[s]
        open_ -= over
    want |= {s: level * weight[s] for s in open_}
    assert got == pytest.approx(want)


# --------------------------------------------------------------------------- the pipeline


def test_pipeline_stages(spark, data, documents):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, data)
        assert docs.columns == columns
        kept[name] = docs.collect()
        docs = spark.createDataFrame(kept[name], docs.schema)
    good = {r.doc_id for r in kept["quality"]}
    labels = pq.read_table(f"{data}/labels.parquet").to_pydict()
    clean = {i for i, q in zip(labels["doc_id"], labels["quality"], strict=True) if q == 1}
    assert len(clean & good) >= 0.97 * len(clean)
    groups = collections.defaultdict(list)
    for r in kept["quality"]:
        groups[brute.lower(r.text)].append(r.doc_id)
    assert {r.doc_id for r in kept["exact"]} == {max(g) for g in groups.values()}
    near = brute.near_components({r.doc_id: r.text for r in kept["exact"]})
    assert {r.doc_id for r in kept["near"]} == {c for _, c in near.values()}
    words = lambda rows: sum(len(brute.WORD.findall(r.text)) for r in rows)
    assert words(kept["mixture"]) == pytest.approx(words(kept["near"]), rel=0.02)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert sum(p.length for p in pieces) == sum(len(x) for x in brute.token_ids([r.text for r in kept["mixture"]], "word_bpe_49k.json"))
    assert [p.length for p in corpus_pipeline.run(spark, data).collect()].__len__() == len(pieces)


@pytest.mark.parametrize("m", [2, 40, 300])
def test_lists_give_a_row_for_each_joined_set_and_not_for_each_pair(m):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(m)
    bases = [rng.integers(1, 2**63, n, dtype=np.uint64) for n in (400, 800, 1600)]
    sets = []
    for i in range(m):  # each set has 9 of 10 shingles of its base
        base = bases[i % 3]
        sets.append(np.sort(np.concatenate([rng.permutation(base)[: len(base) * 9 // 10], rng.integers(1, 2**63, len(base) // 10, dtype=np.uint64)])))
    order = sorted(range(m), key=lambda i: (len(sets[i]), i))
    words = np.array([near_dup.sketch(sets[i]) for i in order]).view(np.int64)
    lines = [np.repeat([7, 9], m), np.tile(order, 2), np.tile([len(sets[i]) for i in order], 2).astype(np.int32), *(np.tile(w, 2) for w in words.T)]
    rows = pa.RecordBatch.from_arrays([pa.array(x) for x in lines], names=["token", "key", "n", "s0", "s1"])
    for exact in (False, True):
        got = [tuple(r.values()) for batch in near_dup._joined(exact)(iter([rows.slice(0, m + 1), rows.slice(m + 1)])) for r in batch.to_pylist()]
        assert sorted(got) == [(i % 3, i) for i in sorted(range(3, m), key=lambda i: (i % 3, i))]


def test_small_sets_that_share_a_shingle_are_joined_only_where_they_can_be_linked():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    fresh = lambda n: rng.integers(1, 2**63, n, dtype=np.uint64)

    def joined(sets):
        words = np.array([near_dup.sketch(s) for s in sets]).view(np.int64)
        order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), i))
        lines = [np.full(len(sets), 7), np.array(order), np.array([len(sets[i]) for i in order], np.int32), *words[order].T]
        rows = pa.RecordBatch.from_arrays([pa.array(x) for x in lines], names=["token", "key", "n", "s0", "s1"])
        return [tuple(r.values()) for batch in near_dup._joined(False)(iter([rows])) for r in batch.to_pylist()]

    common = fresh(1)
    assert not joined([np.unique(np.append(common, fresh(39))) for _ in range(300)])
    for n in [*range(1, 140)] * 4:  # as far apart as linked sets can be
        own = min(n // 9, (2 * n) // 18)
        shared = fresh(n - own)
        x, y = (np.unique(np.concatenate([shared, fresh(own)])) for _ in range(2))
        assert near_dup.linked(len(shared), len(x), len(y)) and len(joined([x, y])) == 1
        more = np.unique(np.append(x, fresh(len(x) // 4)))
        assert near_dup.linked(len(x), len(x), len(more)) and len(joined([x, more])) == 1


def shuffled(spark):
    """The shuffle files that the session's folders hold."""
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f.rsplit("/", 1)[-1] for f in found.split("\n") if "/shuffle_" in f}


def test_a_staged_table_leaves_no_shuffle_files(spark):
    import time

    from larkspur.llm import common

    before = shuffled(spark)
    for several in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", several)
        rows = common.stage(spark.range(1000).repartition(3, "id").groupBy(F.expr("id % 7").alias("k")).count(), "test")
        for _ in range(50):  # files go in the background
            if left := shuffled(spark) - before:
                time.sleep(0.1)
        assert not left
        assert sorted(map(tuple, rows.collect()))[0] == (0, 143)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert spark.conf.get(common.CLEANUP, None) is None


def test_seeds_go_once_their_places_are_joined(spark, awkward):
    import pathlib

    from larkspur.llm import common

    folder = pathlib.Path(common.shared_dir(spark).removeprefix("file:"), "larkspur")
    before = {p.name for p in folder.glob("*")}
    rows = substring_dedup.repeated_passages(awkward)
    assert {p.name.split("-")[0] for p in folder.glob("*") if p.name not in before} == {"matches", "chains"}
    assert {(7, 6), (8, 6), (10, 9)} <= {(r.doc_id, r.ref_doc_id) for r in rows.collect()}
