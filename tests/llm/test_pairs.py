"""Problems 1, 3, 8 and 10 against brute force, with the awkward cases."""

import random
import time
from itertools import combinations

import pytest

from newsloom.llm import components, leakage, shared_spans
from newsloom.llm import history_index as hi
from newsloom.llm import kernels as K
from newsloom.llm import near_duplicates as nd

RNG = random.Random(3)
VOCABULARY = [f"word{k}" for k in range(400)]


def sentence(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def edited(text, share):
    ws = text.split()
    for k in range(len(ws)):
        if RNG.random() < share:
            ws[k] = RNG.choice(VOCABULARY)
    return " ".join(ws)


@pytest.fixture(scope="module")
def texts():
    base = [sentence(80) for _ in range(25)]
    out = base + [edited(t, s) for t in base for s in (0.02, 0.05, 0.1)] + base[:5]
    out += ["", None, "too short", sentence(20), sentence(6000)]
    return list(enumerate(out, 1))


def shingles(text):
    ws = K.words(text)
    return {tuple(ws[k : k + 3]) for k in range(len(ws) - 2)}


def similar(texts, least=0.6):
    sets = {i: shingles(t) for i, t in texts if t and len(K.words(t)) >= 20}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("hot", [256, 2])
def test_forest_finds_all_pairs(spark, texts, hot):
    df = spark.createDataFrame([(i, None, t, "x", 1) for i, t in texts] + [(None, "a", sentence(50), "y", 2)], "id long, title string, content string, rep string, key int")
    classes, links = nd.near_duplicates(df, nd.Forest(threshold=0.6, shingle=3, hot=hot))
    got = [tuple(r) for r in nd.all_pairs(classes, links).collect()]
    assert len(got) == len(set(got))
    assert set(got) == similar(texts)


def test_forest_shortens_until_the_recall_is_reached():
    p = nd.Forest(threshold=0.6, shingle=3)
    assert p.recall(0.6, 3) >= p.target_recall > p.recall(0.6, 4)
    assert p.enough(3, 0, 0.0) and not p.enough(4, 0, 0.0)
    # Many links, all of them very alike: the long prefixes have met them.
    assert p.enough(4, 10_000, 0.01) and not p.enough(4, 10_000, 50.0)


def test_groups_are_components(spark, texts):
    df = spark.createDataFrame([(i, None, t) for i, t in texts], "id long, title string, content string")
    got = {r.id: r for r in nd.groups(*nd.near_duplicates(df, nd.Forest(threshold=0.6, shingle=3))).collect()}
    parent = {i: i for i in got}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in similar(texts):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert {i: r.component for i, r in got.items()} == {i: root(i) for i in got}
    assert all(r.depth in (None, 1, 2, 3, 4) and (r.depth is None) == (r.links == 0) for r in got.values())


def test_components_of_paths_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 150)} | {200: 200, 201: 200}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [1000, 2])
def test_pairs_of_copies_in_blocks(spark, block):
    classes = spark.createDataFrame([(i, 1) for i in range(1, 8)] + [(8, 8), (9, 8), (10, 10)], "id long, rep long")
    links = spark.createDataFrame([(1, 10)], "a long, b long")
    got = [tuple(r) for r in nd.all_pairs(classes, links, block).collect()]
    assert len(got) == len(set(got)) and set(got) == set(combinations(range(1, 8), 2)) | {(8, 9)} | {(i, 10) for i in range(1, 8)}


def test_forest_of_an_empty_table(spark):
    classes, links = nd.near_duplicates(spark.createDataFrame([], "id long, title string, content string"))
    assert classes.count() == 0 and links.count() == 0


def asked_in_turn(index, epochs):
    """(epoch, doc) of all repeats, batch by batch."""
    out = set()
    for e in epochs:
        out |= {r.doc for r in index.repeats(e).collect()}
        index.append(e)
    return out


@pytest.mark.parametrize(("leaders", "exact"), [(64, False), (2, True)])
def test_history_index_equals_brute_force(spark, texts, leaders, exact):
    epochs = {i: RNG.choice([0, 1, 2]) for i, _ in texts}
    urls = {i: f"https://www.a.example/{i % 40}?utm_source=x" if i % 3 else None for i, _ in texts}
    rows = [(i, epochs[i], None, t, urls[i], 7) for i, t in texts] + [(None, 1, "a", sentence(40), None, 1), (9999, None, "a", sentence(40), None, 1)]
    docs = spark.createDataFrame(rows, "doc long, epoch int, title string, content string, url string, digest int")
    index = hi.HistoryIndex.create(docs.where("epoch = 0"), hi.CellParams(threshold=0.6, shingle=3, leaders=leaders, exact=exact, parts=2))
    index.stage(docs)
    want = {max(p, key=lambda i: epochs[i]) for p in similar(texts) if epochs[p[0]] != epochs[p[1]]}
    for i, u in urls.items():
        if u and any(v == u and epochs[j] < epochs[i] for j, v in urls.items()):
            want.add(i)
    assert asked_in_turn(index, [0, 1, 2]) == want
    index.close()


def test_history_index_is_opened_again(spark, texts, tmp_path):
    """A second handle sees what the first one appended, and the order it fitted."""
    schema = "doc long, epoch int, title string, content string, url string"
    docs = spark.createDataFrame([(i, i % 2, None, t, None) for i, t in texts], schema)
    first = hi.HistoryIndex.create(docs.where("epoch = 0"), hi.CellParams(threshold=0.6, shingle=3, parts=2), f"file://{tmp_path}/index")
    first.stage(docs.where("epoch = 0"))
    first.append(0)
    first.close()
    second = hi.HistoryIndex.open(spark, f"file://{tmp_path}/index")
    assert second.appended() == [0] and second.p.threshold == 0.6
    second.stage(docs.where("epoch = 1"))
    assert {r.doc for r in second.repeats(1).collect()} == {i for p in similar(texts) for i in p if i % 2 == 1 and any(x % 2 == 0 for x in p)}
    second.close()


def test_history_cells_are_joined_without_moving_the_history(spark, texts):
    schema = "doc long, epoch int, title string, content string, url string"
    docs = spark.createDataFrame([(i, i % 2, None, t, None) for i, t in texts], schema)
    index = hi.HistoryIndex.create(docs, hi.CellParams(threshold=0.6, shingle=3, parts=2))
    index.stage(docs)
    index.append(0)
    index._prepare(1)
    cells = spark.table(index._cells)
    plan = index._met(cells.where("epoch = 1").hint("shuffle_hash"), cells.where("epoch = 0"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ShuffledHashJoin" in plan
    index.close()


def test_history_batches_leave_no_shuffles(spark, texts):
    """What a batch shuffled is let go once it is appended, without waiting for the driver's next collection."""
    held = lambda: spark._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    docs = spark.createDataFrame([(i, i % 3, None, t, None) for i, t in texts], "doc long, epoch int, title string, content string, url string")
    index = hi.HistoryIndex.create(docs.where("epoch = 0"), hi.CellParams(threshold=0.6, shingle=3, parts=2))
    index.stage(docs)
    spark._jvm.System.gc()
    time.sleep(3)
    base = held()
    for e in (0, 1, 2):
        index.ask(e)
        index.append(e)
    until = time.monotonic() + 10
    while held() > base and time.monotonic() < until:
        time.sleep(0.2)
    assert held() <= base
    index.close()


def test_bits_bound_what_vectors_share(spark):
    import numpy as np

    rng, rows, want = np.random.default_rng(5), [], []
    for n, share in [(1, 1.0), (30, 0.0), (140, 0.3), (140, 0.6), (200, 1.0), (900, 0.5), (5000, 0.6)]:
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        y = np.unique(np.r_[x[: int(share * len(x))], rng.integers(0, 1 << 63, n - int(share * len(x))).astype(np.uint64) * np.uint64(2)])
        (bits, over), (qbits, qover) = hi.bitmap(hi.pack(x)), hi.bitmap(hi.pack(y))
        rows.append((len(want), bits.tolist(), over, qbits.tolist(), qover))
        want.append(len(np.intersect1d(hi.unpack(hi.pack(x)), hi.unpack(hi.pack(y)))))
    df = spark.createDataFrame(rows, "k int, bits array<long>, over int, qbits array<long>, qover int")
    got = {r.k: r.most for r in df.select("k", hi.shared_at_most().alias("most")).collect()}
    assert all(got[k] >= w for k, w in enumerate(want))
    # Unlike texts of common lengths are told apart.
    assert got[1] <= 8 and got[2] < 0.75 * 140


def test_history_batches_move_their_cells_once(spark, texts, monkeypatch):
    """A batch's vectors stay where they are, its cells move once into their buckets and are probed there, also beside the leaders."""
    plans = {"cells": [], "p3-pairs": []}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    bucketed, kept = hi.HistoryIndex._bucketed, hi._kept

    def write(self, df, name, key, *rest):
        if key == "key":
            plans["cells"].append(plan(df))
        bucketed(self, df, name, key, *rest)

    def keep(df, name):
        plans.setdefault(name, []).append(plan(df))
        return kept(df, name)

    monkeypatch.setattr(hi.HistoryIndex, "_bucketed", write)
    monkeypatch.setattr(hi, "_kept", keep)
    docs = spark.createDataFrame([(i, i % 2, None, t, None) for i, t in texts], "doc long, epoch int, title string, content string, url string")
    index = hi.HistoryIndex.create(docs.where("epoch = 0"), hi.CellParams(threshold=0.6, shingle=3, leaders=1, exact=True, parts=2))
    index.stage(docs)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index.append(0)
        index.ask(1)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans["cells"]) == 2 and all(x.count("Exchange hashpartitioning(key") == 1 and "SortMergeJoin" not in x for x in plans["cells"])
    assert len(plans["p3-pairs"]) == 1 and plans["p3-pairs"][0].count("Exchange hashpartitioning") == 1
    assert len(plans["p3-close"]) == 1
    index.close()


def test_history_index_without_history(spark):
    docs = spark.createDataFrame([], "doc long, epoch int, title string, content string, url string")
    index = hi.HistoryIndex.create(docs)
    index.stage(docs)
    assert index.appended() == []
    index.append(0)
    assert index.repeats(1).count() == 0
    index.close()


def test_vectors_are_stored_without_loss_of_order():
    import numpy as np

    sh = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    assert (hi.unpack(hi.pack(sh)) == sh >> np.uint64(24)).all() and hi.unpack(hi.pack(sh[:0])).size == 0


def test_leaks_and_their_removal(spark):
    item = sentence(30)
    docs = [(1, "before " * 5 + item.upper().replace(" ", ", ") + " after"), (2, " ".join(item.split()[3:16])), (3, " ".join(item.split()[:12])), (4, None), (5, ""), (6, sentence(5000) + " " + item)]
    items = spark.createDataFrame([(9, item, "x"), (10, None, "y"), (11, "short", "z"), (12, item, "w")], "item_id long, text string, id string")
    df = spark.createDataFrame(docs, "id long, text string")
    for block in (1_000_000, 50):
        found = leakage.leaks(df, items, block_grams=block)
        assert {(r.item_id, r.id) for r in found.collect()} == {(i, d) for i in (9, 12) for d in (1, 2, 6)}
    clean = {r.id: r for r in leakage.without_leaks(df, found).collect()}
    assert clean[1].text.split() == ["before"] * 5 + ["after"] and clean[2].text == "" and clean[3].text == docs[2][1]
    assert clean[4].text is None and clean[3].leaked_chars == 0
    assert leakage.leaks(df.limit(0), items).count() == 0 and leakage.leaks(df, items.limit(0)).count() == 0


def stretch(n):
    return "".join(RNG.choice("abcdefghij ") for _ in range(n))


@pytest.mark.parametrize("hot", [256, 2])
def test_shared_spans_equal_brute_force(spark, hot):
    shared = [stretch(n) for n in (300, 299, 420, 900)]
    docs = [stretch(RNG.randrange(350)) + s + stretch(RNG.randrange(350)) for s in shared for _ in range(3)]
    docs += [docs[0], docs[0], "é" * 700, "é" * 500, "", None, shared[0], stretch(299)]
    rows = list(enumerate(docs, 1))
    windows = {i: {t[k : k + 300] for k in range(len(t) - 299)} for i, t in rows if t}
    want = {(a, b) for a, b in combinations(sorted(windows), 2) if windows[a] & windows[b]}
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "id long, text string, rep int")
    classes, spans = shared_spans.shared_spans(df, shared_spans.SpanParams(hot=hot))
    got = [tuple(r) for r in nd.all_pairs(classes, spans.select("a", "b").distinct()).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    share = {r.id: r for r in shared_spans.shared_share(df, shared_spans.SpanParams(hot=hot)).collect()}
    assert share[1].shared_chars == len(docs[0])  # a copy
    covered = set()
    for k in range(len(docs[6]) - 299):
        if any(docs[6][k : k + 300] in windows[j] for j in windows if j != 7):
            covered |= set(range(k, k + 300))
    assert share[7].shared_chars == len(covered)
    assert shared_spans.shared_share(df.limit(0)).count() == 0


def test_removals_leave_every_stretch_once(spark):
    shared = [stretch(400), stretch(500)]
    docs = ["", shared[0] + stretch(50), stretch(40) + shared[0] + stretch(10) + shared[1], shared[1] + stretch(77), stretch(600), None]
    docs.append(docs[1])
    df = spark.createDataFrame(list(enumerate(docs)), "id long, text string")
    rows = shared_spans.removals(df).collect()
    texts = dict(enumerate(docs))
    for r in sorted(rows, key=lambda r: -r.from_char):
        texts[r.id] = texts[r.id][: r.from_char] + texts[r.id][r.to_char :]
    assert {r.component for r in rows} == {1} and {r.id for r in rows} == {2, 3, 6}
    assert texts[6] == "" and all(sum(s in (t or "") for t in texts.values()) == 1 for s in shared)
    assert shared_spans.removals(df.limit(0)).count() == 0


def test_pairs_that_share_only_hot_prefixes(spark):
    block = " ".join(f"shared{k}" for k in range(92))
    rows = [(i, None, block + " " + " ".join(f"own{i}x{k}" for k in range(28))) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, title string, content string")
    p = nd.Forest(threshold=0.6, shingle=3, hot=8)
    _, links = nd.near_duplicates(df, p)
    # Every two of them are at 90 / 146.
    assert links.count() >= 0.99 * 120 * 119 / 2
