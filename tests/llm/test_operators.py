"""Each operator on odd rows, on empty tables, and against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.llm import chat, decontaminate, fingerprint, language_id, licenses, mixing, near_dedup, pii, quality, tokens
from tidemill.llm.queries import QUERIES


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))


# ---------------------------------------------------------------- near duplicates
def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_dedup_matches_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op9_near_dedup"](spark, sf).collect()}
    assert got == brute_components(rows)


def test_near_dedup_edited_copies(spark):
    """Copies of one text that are similar to it, but often not to each other, and a chain."""
    rng = np.random.default_rng(5)
    base = [f"w{rng.integers(10**6)}" for _ in range(200)]
    rows = [(1000, " ".join(base))]
    for k in range(60):
        w = list(base)
        for at in rng.choice(200, 5, replace=False):
            w[at] = f"x{k}_{at}"
        rows.append((k, " ".join(w)))
    for k in range(20):
        base = base[10:] + [f"c{k}_{j}" for j in range(10)]
        rows.append((2000 + k, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, tile=4000).collect()}
    assert got == brute_components(rows)


def test_near_dedup_odd_rows(odd, nothing):
    got = defaultdict(list)
    for r in near_dedup.near_duplicates(odd).collect():
        got[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert got[0][0][1:] == (0, True) and got[1][0][1:] == (0, False) and got[2][0][1] == 0
    assert got[3] == [(0, 3, True)] and got[4] == [(0, 4, True)] and got[5] == [(0, 5, True)]
    assert got[6] == [(1, 6, True)] and len(got[10]) == 2 and got[9] == [(1, 9, True)]
    assert near_dedup.near_duplicates(nothing).count() == 0
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {0, 3, 4, 5, 6, 7, 8, 9, 10, 12}


def test_min_max_signature_is_unbiased():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:600], rng.integers(0, 2**63, 300, dtype=np.uint64)]))
    both = len(np.intersect1d(a, b))
    sig = near_dedup.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 512)
    assert abs((sig[0] == sig[1]).mean() - both / (len(a) + len(b) - both)) < 0.05
    assert near_dedup.miss_probability(0.75) < 1e-5


def test_bands_take_different_permutations():
    """Two sets of 3 and 4 shingles share a band as often as four independent values agree: 0.75 ** 4."""
    rng = np.random.default_rng(2)
    n = 3000
    words = [[f"w{x}" for x in rng.integers(0, 10**9, 8)] for _ in range(n)]
    keys = []
    for cut in (8, 7):
        batch = pa.record_batch([pa.array(range(n), pa.int64()), pa.array([" ".join(w[:cut]) for w in words])], names=["doc_id", "text"])
        keys.append(np.array(sum((b.column(4).to_pylist() for b in near_dedup._sketch(5, 64, 4)([batch])), [])))
    assert abs((keys[0] == keys[1]).mean() - 0.75**4) < 0.01
    missed = near_dedup.miss_probability(0.75, union=4)
    assert missed < near_dedup.miss_probability(0.75, union=8) < near_dedup.miss_probability(0.75) < 6e-6


def test_tile_decides_on_full_sets_alone():
    """A pair at exactly 0.75 is linked whatever share of its signature values agrees."""
    sets = [np.arange(100, 107, dtype=np.uint64), np.arange(101, 108, dtype=np.uint64)]
    key = np.array([7, 9], np.int64).tobytes()
    pdf = pd.DataFrame({"key": [7] * 3, "lo": [0] * 3, "hi": [0] * 3, "node": [1, 2, 1], "root": [1, 2, 1], "n_shingles": [7] * 3, "side": [0, 1, 1], "outside": [True, False, True], "keys": [key] * 3, "members": [x.tobytes() for x in (*sets, sets[0])]})
    assert near_dedup._tile_links(75, 100)(pdf).to_numpy().tolist() == [[1, 2]]


def test_tiles_meet_every_pair_of_components(spark):
    """Every pair of members of different components is in exactly one tile as a pair to look at."""
    rows = [(k, i, 0 if i < 40 else i // 2, 10 + i) for k in (1, 2) for i in range(40 + 10 * k)] + [(3, 1, 0, 5), (3, 2, 0, 5)]
    df = spark.createDataFrame(rows, "key long, node long, root long, n_shingles long")
    found = defaultdict(int)
    for _, t in near_dedup.tiles(df, 4096).toPandas().groupby(["key", "lo", "hi"]):
        for a in t[t.side == 0].itertuples():
            for b in t[t.side == 1].itertuples():
                if a.root != b.root and (not b.outside or b.node > a.node):
                    found[a.key, min(a.node, b.node), max(a.node, b.node)] += 1
    want = {(k, i, j) for k, i, r, _ in rows for k2, j, r2, _ in rows if k == k2 and i < j and r != r2}
    assert set(found) == want and set(found.values()) == {1}


def test_near_dedup_recall_at_the_threshold(spark):
    """5,000 pairs of similarity 0.75 to 0.78, and as many just below 0.75, all decided as brute force does."""
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for k in range(10002):
        n = int(rng.integers(40, 90))
        a = [f"p{k}x{j}" for j in range(n + 4)]
        b = a[(n // 4 if k % 2 else n // 4 + 1) :]
        both, union = len(b) - 4, n
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        want[2 * k + 1] = 2 * k if 100 * both >= 75 * union else 2 * k + 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    linked = [i for i, c in want.items() if c != i]
    assert len(linked) >= 5000 and len(want) - len(linked) >= 2500 and all(got[i] == c for i, c in want.items())


# ---------------------------------------------------------------- decontamination
def brute_contamination(docs, bench):
    out = {}
    items = [(str(i), words(t)) for i, t in bench]
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for name, b in items:
            for k in range(max(1, len(b) - 9) if b else 0):
                win = b[k : k + 10]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        found.add(name)
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


BENCH = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short one"), (3, ""), (4, None), (12, "Beta GAMMA delta epsilon zeta eta theta iota kappa lambda nu")]


def test_decontamination_matches_brute_force(spark, odd, nothing):
    docs = [(1, "x alpha, beta gamma delta epsilon zeta eta theta iota kappa lambda mu y"), (2, "a short one and a short one"), (3, None), (4, ""), (5, "kappa lambda mu"), (6, "beta gamma delta epsilon zeta eta theta iota kappa LAMBDA " * 3), (7, "short"), (8, "one short one short ónè one")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(BENCH, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(d, b).collect()}
    assert got == brute_contamination(docs, BENCH)
    assert {r.doc_id for r in decontaminate.remove_contaminated(d, b).collect()} == {i for i, v in got.items() if not v[4]}
    found = {(r.doc_id, r.item_id, r.doc_start, r.item_start, r.n_words) for r in decontaminate.matches(d, b).collect()}
    assert (1, "1", 1, 0, 12) in found and (2, "2", 1, 0, 2) in found
    assert decontaminate.contamination(odd, b).count() == odd.count()
    assert decontaminate.contamination(nothing, b).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(d, b.limit(0)).collect())


def test_decontamination_in_blocks(spark, monkeypatch):
    docs = [(1, "x alpha, beta gamma delta epsilon zeta eta theta iota kappa lambda mu y"), (2, "a short one"), (3, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(BENCH, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(d, b).collect()}
    assert got == brute_contamination(docs, BENCH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.lists(st.lists(st.sampled_from("abc"), max_size=8), max_size=4))
def test_suffix_array_finds_every_window(doc, items):
    import pyarrow as pa

    t = decontaminate.TestItems(list(range(len(items))), [" ".join(x) for x in items], 3)
    data = np.frombuffer(" ".join(doc).encode(), np.uint8)
    _, r, pos, which = decontaminate.occurrences(data, np.array([0, len(data)]), t)
    got = {(int(p), int(t.place_item[x]), int(t.place_off[x])) for p, w in zip(pos, which) for x in range(t.place_from[w], t.place_from[w + 1])}
    assert len(which) == len(set(zip(pos.tolist(), which.tolist()))) <= 3 * max(1, len(doc))
    want = set()
    for i, b in enumerate(items):
        for k in range(max(1, len(b) - 2) if b else 0):
            win = b[k : k + 3]
            want |= {(p, i, k) for p in range(len(doc) - len(win) + 1) if doc[p : p + len(win)] == win}
    assert got == want and pa
    runs = {tuple(int(x) for x in m) for part in decontaminate.longest(data, np.array([0, len(data)]), t) for m in zip(*part)}
    brute = set()
    for i, b in enumerate(items):
        for p in range(len(doc)):
            for k in range(len(b)):
                if doc[p] == b[k] and (p == 0 or k == 0 or doc[p - 1] != b[k - 1]):
                    n = 0
                    while p + n < len(doc) and k + n < len(b) and doc[p + n] == b[k + n]:
                        n += 1
                    if n >= min(3, len(b)):
                        brute.add((0, i, p, k, n))
    assert runs == brute


def test_decontamination_of_repeated_words_is_bounded():
    """One item of 400 equal words, 2,000 items that share a window, and a text of 40,000 equal words."""
    import tracemalloc

    shared = " ".join(f"w{k}" for k in range(10))
    t = decontaminate.TestItems(list(range(2001)), ["a " * 400] + [f"{shared} x{k}" for k in range(2000)], 10)
    data = np.frombuffer(("a " * 40000 + f"{shared} y " * 500).encode(), np.uint8)
    tracemalloc.start()
    n, r, pos, which = decontaminate.occurrences(data, np.array([0, len(data)]), t)
    names = t.items_by_row(r, which)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert len(pos) == 39991 + 500 and len(names[0]) == 2001


# ---------------------------------------------------------------- mixing
def test_pivot_keeps_words_and_expectations():
    rng = np.random.default_rng(2)
    p, size = rng.random(50), rng.integers(1, 100, 50).astype(float)
    total = np.zeros(50)
    for _ in range(400):
        q, hand = mixing.pivot(p, size, rng.random(50))
        assert sum(0 < x < 1 for x in q) <= 1 and abs((q * size).sum() - (p * size).sum()) < 1e-6
        total += q
    assert np.abs(total / 400 - p).max() < 0.12


def test_mix_targets_and_rerun(spark, sf, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = mixing.mix_sources(docs).toPandas()
    g = a.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"), most=("size", "max"))
    assert (g.target <= 2 * g["size"] + 1e-6).all() and abs(g.target.sum() - 1.5 * g["size"].sum()) < 1e-3
    assert ((g.taken - g.target).abs() <= g.most).all() and (a.taken <= 2 * a["size"]).all()
    b = mixing.mix_sources(docs.repartition(5)).toPandas()
    assert a.sort_values("doc_id").taken.tolist() == b.sort_values("doc_id").taken.tolist()


def test_mix_weights_by_hand(spark):
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (n, s) in enumerate([(100, "a"), (100, "b"), (100, "c"), (100, None)])], "doc_id long, text string, source string")
    got = {r.source: r.target for r in mixing.mix_sources(docs).collect()}
    # weights 5, 2, 1, 5 of 600: a and null stop at 200, the other 200 go 2 to 1
    assert got["a"] == got[None] == 200 and abs(got["b"] - 400 / 3) < 1e-9 and abs(got["c"] - 200 / 3) < 1e-9


def test_mix_odd_rows(odd, nothing):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == odd.count() and {r.size for r in got if r.doc_id in (3, 4, 5)} == {0}
    assert mixing.mix_sources(nothing).count() == 0
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mixed(nothing).count() == 0


def brute_pivot(p, size, luck):
    """The rounding of one block with plain lists, fraction by fraction."""
    p, hand = list(p), None
    for k in range(len(p)):
        if min(p[k], 1 - p[k]) <= mixing.EPS:
            p[k] = float(round(p[k]))
            continue
        if hand is None:
            hand = k
            continue
        up, down = min((1 - p[hand]) * size[hand], p[k] * size[k]), min(p[hand] * size[hand], (1 - p[k]) * size[k])
        give = up if luck[k] * (up + down) < down else -down
        p[hand], p[k] = p[hand] + give / size[hand], p[k] - give / size[k]
        whole = [i for i in (hand, k) if min(p[i], 1 - p[i]) <= mixing.EPS]
        for i in whole:
            p[i] = float(round(p[i]))
        hand = next((i for i in (hand, k) if i not in whole), None)
    return p


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 50), st.floats(0, 0.999)), max_size=30))
def test_pivot_matches_brute_force(rows):
    p, size, luck = (np.array([r[k] for r in rows], float) for k in range(3))
    got, _ = mixing.pivot(p, size, luck)
    assert np.allclose(got, brute_pivot(p, size, luck))


def test_mix_takes_rows_not_ids(spark):
    """Repeated ids, null ids and equal rows: the words of ``mixed`` are those of the plan."""
    rows = [(1, "w " * 10, "a", 1)] * 30 + [(1, "v " * k, "a", 2) for k in range(1, 40)] + [(None, "u " * k, "b", 3) for k in range(1, 40)] + [(None, "t t t", "b", 4)] * 25 + [(2, None, "c", 5), (3, "", None, 6), (4, "x y", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra long")
    plan = mixing.mix_sources(docs).toPandas()
    assert len(plan) == len(rows) and (plan.taken <= 2 * plan["size"]).all()
    out = mixing.mixed(docs).toPandas()
    for source, g in plan.groupby("source", dropna=False):
        mine = out[out.source.isna() if pd.isna(source) else out.source == source]
        words = sum(len(t.split()) for t in mine.text)
        assert words == g.taken.sum() and abs(words - g.target.iloc[0]) <= g["size"].max()
    equal = plan[(plan["size"] == 10) & (plan.source == "a") & (plan.doc_id == 1)].copies
    assert equal.max() - equal.min() <= 1
    shuffled = mixing.mixed(docs.repartition(7)).toPandas()
    assert sorted(map(str, out.values.tolist())) == sorted(map(str, shuffled.values.tolist()))


# ---------------------------------------------------------------- tokens
@settings(max_examples=50, deadline=None)
@given(st.integers(1, 20), st.data())
def test_packing_round_trip(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=200)), np.uint32)
    raw = tokens.pack(ids, bits)
    assert len(raw) == (len(ids) * bits + 7) // 8
    assert (tokens.unpack(raw, bits, 0, len(ids)) == ids).all()
    if len(ids):
        a = data.draw(st.integers(0, len(ids) - 1))
        assert (tokens.unpack(raw, bits, a, len(ids) - a) == ids[a:]).all()


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("ab'sS1 \n\t\r.,!é  　ñ²ⅷ́中<|>")), max_size=40))
def test_pieces_encode_like_whole_texts(text):
    if not hasattr(test_pieces_encode_like_whole_texts, "enc"):
        test_pieces_encode_like_whole_texts.enc = tokens.Encoder(tokens.default_tokenizer())
    enc = test_pieces_encode_like_whole_texts.enc
    assert enc.encode([text]) == enc.whole([text])


def test_token_files(spark, odd, nothing, tmp_path):
    tokens.write_tokens(odd, f"file://{tmp_path}/t", block_ids=50)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens.token_index(spark, f"file://{tmp_path}/t").collect())
    enc, at, want, every = tokens.Encoder(tokens.default_tokenizer()), 0, [], []
    for r in sorted(odd.collect(), key=lambda r: r.doc_id):
        ids = [*np.frombuffer(enc.whole([r.text or ""])[0], enc.kind).tolist(), 0]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
        every += ids
    assert got == want
    assert tokens.read_ids(spark, f"file://{tmp_path}/t", 30, 100).tolist() == every[30:130]
    tokens.write_tokens(nothing, f"file://{tmp_path}/n")
    assert tokens.token_index(spark, f"file://{tmp_path}/n").count() == 0


# ---------------------------------------------------------------- language
def test_language_held_out(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op5_language_id"](spark, sf).collect()}
    rows = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out for r in rows)
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in rows]) > 0.95


def test_language_odd_rows(odd, nothing):
    net = language_id.fit(language_id.training_rows(odd))
    got = {r.doc_id: r for r in language_id.predict(odd, net).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 5, 7))
    assert got[9].lang_pred in ("en", "fr") and 0 <= got[9].score <= 1
    assert language_id.predict(nothing, net).count() == 0
    none = language_id.fit(language_id.training_rows(nothing))
    assert {r.lang_pred for r in language_id.predict(odd, none).collect()} == {"und"}
    kept = language_id.accept(odd, net, 0.0)
    assert kept.columns == odd.columns and {3, 4, 5, 7}.isdisjoint({r.doc_id for r in kept.collect()})


# ---------------------------------------------------------------- fingerprints
def test_fingerprints(odd, nothing, spark, sf):
    got = sorted(fingerprint.fingerprints(odd).collect(), key=lambda r: r.doc_id)
    rows = sorted(odd.collect(), key=lambda r: r.doc_id)
    for k, (r, d) in enumerate(zip(got, rows)):
        t, nxt = d.text or "", rows[(k + 1) % len(rows)].text or ""
        n = len(t) // 2
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest()
    assert got[0].fingerprint == got[1].fingerprint and got[0].near_next == 1.0
    assert got[3].fingerprint == "" and got[3].near_next == 1.0 and got[5].near_next == 0.0
    assert fingerprint.fingerprints(nothing).count() == 0
    one = fingerprint.fingerprints(odd.where("doc_id = 6")).first()
    assert one.near_next == 1.0


def test_fingerprint_buckets_follow_the_rows(spark):
    """Crowded ids beside one far away, null ids, and one id for many texts: no bucket holds much, and each next row is right."""
    rows = [(i, f"text number {i} " * 20) for i in range(3000)] + [(2**60, "far " * 50)] + [(None, f"nobody {i} " * 20) for i in range(1500)] + [(9999, f"shared {i} " * 20) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cuts = fingerprint.cut_points(df, 50, len(rows))
    sizes = [r["count"] for r in fingerprint.add_bucket(df, cuts).groupBy("bucket").count().collect()]
    assert len(sizes) > 45 and max(sizes) < 400
    got = fingerprint.fingerprints(df).select("doc_id", "n_chars", "edited_sha256").collect()
    assert len(got) == len(rows)
    order = {}
    for r in df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect():
        order[r.doc_id is not None, r.doc_id or 0, r.h] = r.text
    texts = [order[k] for k in sorted(order)]
    want = [hashlib.sha256((t[: len(t) - len(t) // 2] + texts[(k + 1) % len(texts)][: len(t) // 2]).encode()).hexdigest() for k, t in enumerate(texts)]
    assert sorted(r.edited_sha256 for r in got) == sorted(want)


def test_fingerprint_estimates_weighted_jaccard(spark, sf):
    from collections import Counter

    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    off = []
    for k, (i, t) in enumerate(docs):
        nxt = docs[(k + 1) % len(docs)][1]
        n = len(t) // 2
        a, b = Counter(low(t).split()), Counter(low(t[: len(t) - n] + nxt[:n]).split())
        both = sum(min(a[w], b[w]) for w in a)
        off.append(got[i].near_edited - both / (sum(a.values()) + sum(b.values()) - both))
        sig, other = ([got[i][c][k : k + 8] for k in range(0, len(got[i][c]), 8)] for c in ("fingerprint", "edited_fingerprint"))
        assert len(sig) in (0, fingerprint.SAMPLES) and (not sig or abs(np.mean([x == y for x, y in zip(sig, other)]) - got[i].near_edited) < 1e-9)
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.08


# ---------------------------------------------------------------- personal data
def test_base_spans_equal_the_patterns():
    texts = [
        "a@b.co, x.y+z@d-e.f.g! @no.com a@b a@b@c.de q@.x 1@2.3", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.002.3.255", "4111 1111 1111 1111 5500-0000-0000-0004 1234567890123 4111  1111",
        "+1 (523) 555-1055, +12 +123456789 +1-2.3(4)5678901234567", "@@@ a@@b.c é@x.yz", "",
    ]
    for t in texts:
        want = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(re.sub(r"\D", "", m[0])) <= 19 and pii.luhn(re.sub(r"\D", "", m[0]))]
        want += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
        assert pii.base_spans(t) == want


def test_crf_decodes_long_runs_whole():
    """Phone numbers in a list of some hundred tokens, none of them lost at a cut."""
    net, one = pii.train(), "one two three (523) 555-1055 "  # 300 tokens
    text = one * 60
    got = pii.crf_spans(net, [text], [pii.base_spans(text)])[0]
    assert [x[1] for x in sorted(got, key=lambda x: x[1])] == [k * len(one) + len("one two three ") for k in range(60)]


def decode(net, line):
    plain, tok, tags, _ = pii.labelled_tokens(line)
    score = net.scores([plain[a:b] for a, b in tok])
    return score, net.viterbi(score[None], np.array([len(tok)])), tags


@pytest.fixture(scope="module")
def net():
    return pii.train()


def test_crf_learns_its_table_and_adds_spans(net):
    for line in pii.LABELLED:
        _, (got, _, _), tags = decode(net, line)
        assert got[0].tolist() == tags
    text = "please ring (523) 555-1055 about version 2.0.1 of 2024-01-15"
    got = pii.crf_spans(net, [text], [pii.base_spans(text)])[0]
    assert [text[a:b] for _, a, b in got] == ["(523) 555-1055"]
    clean = ["in 2019 there were 365 days", "order 12345678 of 03/04/2021", "ip 300.1.2.3", "plain words only"]
    assert pii.crf_spans(net, clean, [[]] * 4) == [[], [], [], []]


def test_crf_on_held_out_lines(net):
    precision, recall = pii.held_out_quality(net)
    assert precision >= 0.9 and recall >= 0.8
    assert not {x for x in pii.HELD_OUT if x in pii.LABELLED}


def test_viterbi_and_margin_match_enumeration():
    """Best labelling, and the best one with a stretch outside, over all labellings of short runs; padded rows too."""
    from itertools import product

    rng = np.random.default_rng(4)
    net = pii.Crf()
    net.move += rng.normal(0, 1, net.move.shape)
    net.first += rng.normal(0, 1, net.first.shape)
    k, runs = len(pii.LABELS), [rng.normal(0, 2, (n, len(pii.LABELS))) for n in (1, 2, 3, 4)]
    batch = np.zeros((4, 4, k))
    for r, x in enumerate(runs):
        batch[r, : len(x)] = x
    tags, ahead, behind = net.viterbi(batch, np.array([1, 2, 3, 4]))
    for r, x in enumerate(runs):
        n = len(x)
        total = {y: net.first[y[0]] + x[range(n), y].sum() + sum(net.move[p, q] for p, q in zip(y, y[1:])) for y in product(range(k), repeat=n)}
        best = max(total, key=total.get)
        assert tuple(tags[r, :n]) == best
        for a, b in ((0, n), (n - 1, n), (0, 1), (n // 2, n)):
            outside = max(v for y, v in total.items() if not any(y[a:b]))
            assert abs(net.margin(x, ahead[r, :n], behind[r, :n], a, b) - (total[best] - outside)) < 1e-9


def test_crf_finds_secrets_and_long_tokens(net):
    text = 'x token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" y, the phone: (523) 555-1055 today . . . . . . ' + "7" * 300000 + " and " + "a1" * 100000
    got = sorted(pii.base_spans(text) + pii.crf_spans(net, [text], [pii.base_spans(text)])[0])
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in got][:2] == [("phone", "(523) 555-1055"), ("secret", "9b0b3c6a43eb78aa99cbd7049c572391524f37a8")]


def test_personal_data_odd_rows(odd, nothing):
    got = {r.doc_id: r for r in pii.personal_data(odd).collect()}
    r = got[10]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert got[4].spans == got[3].spans == "" and got[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert "[EMAIL]" in pii.redact("mail me at jane.doe@mail.example.com", r.spans.split(",")[0])
    assert pii.personal_data(nothing).count() == 0


# ---------------------------------------------------------------- licenses
def test_license_scan(spark, odd, nothing):
    got = {r.doc_id: r for r in licenses.license_scan(odd).collect()}
    assert got[12].base_labels == "apache,cc-by,gpl,mit" and got[12].n_base == 4 and got[12].first_word == 3 and got[12].score == 1.0
    assert got[4].n_words == 0 and got[4].first_word is None and got[4].labels == ""
    notice = "x y z. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    d = spark.createDataFrame([(1, notice), (2, "mit license mit license"), (3, "permission to use a copy"), (4, " ".join(["pad"] * 100) + " " + notice)], "doc_id long, text string")
    r = {x.doc_id: x for x in licenses.license_scan(d).collect()}
    assert r[1].labels == "mit" and r[1].base_labels == "" and r[1].score == 1.0 and r[4].labels == "mit"
    assert (r[2].n_base, r[2].first_word, r[2].last_word) == (2, 0, 2) and r[3].labels == "" and r[3].score == 0.0
    assert licenses.license_scan(nothing).count() == 0


def test_set_join_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = licenses.vocabulary() + ["zzz", "yyy"]
    rows = [(i, " ".join(rng.choice(vocab, int(rng.integers(1, 400))))) for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    best = {}
    for i, t in rows:
        w = t.split()
        for s in range(len(w)):  # every start
            for label, text in licenses.TEMPLATES:
                need = set(text.split())
                share = len(need & set(w[s : s + licenses.WINDOW])) / len(need)
                if share >= 0.6 - 1e-9:
                    best[i, label] = max(best.get((i, label), 0), share)
    got = {(r.doc_id, b.label): b.containment for r in licenses.license_scan(d, 0.6).collect() for b in r.matches}
    assert got == best and best


def test_license_block_may_start_anywhere(spark):
    """The whole notice, at every offset, and with many templates."""
    label, notice = licenses.TEMPLATES[3]
    rows = [(k, " ".join(["pad"] * k) + " " + notice + " tail" * 50) for k in range(70)]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.labels, r.score) for r in got} == {(label, 1.0)}
    many = [(f"x{k}", " ".join(f"t{k}w{j}" for j in range(12)) + " the of and") for k in range(300)]
    d = spark.createDataFrame([(k, "so " * 40 + many[k][1] + " end" * 90) for k in range(300)], "doc_id long, text string")
    assert {(r.doc_id, r.labels) for r in licenses.license_scan(d, 0.85, many).collect()} == {(k, f"x{k}") for k in range(300)}


# ---------------------------------------------------------------- quality
def test_quality(spark, odd, nothing):
    got = {r.doc_id: r for r in QUERIES["op10_quality"](spark, "/root/testdata/sf0.01").collect()}
    lab = [r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if got[r.doc_id].held_out]
    assert np.mean([got[r.doc_id].predicted == r.quality for r in lab]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(13)], "doc_id long, quality int, toxic int")
    model = quality.fit(odd, labels)
    assert quality.score(odd, model).count() == odd.count() and quality.score(nothing, model).count() == 0
    blank = quality.fit(nothing, labels.limit(0))
    assert {r.score for r in quality.score(odd, blank).collect()} == {0.5}


def brute_difference(text, good, bad):
    """Sizes by the plain interface, block by block."""
    if not text:
        return 0.0
    sizes = []
    for raw in (good, bad):
        d = zstandard.ZstdCompressionDict(raw)
        sizes.append(sum(len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress(text[s : s + quality.BLOCK])) for s in range(0, len(text), quality.BLOCK)))
    return (sizes[1] - sizes[0]) / len(text)


def test_quality_scores_equal_plain_compression(spark):
    """Whole texts, compressed one by one, give the registered scores; the curve's x are those of whole texts."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, quality.training_labels(spark.read.parquet(f"{sf}/labels.parquet")))
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    for r in docs.collect():
        x = brute_difference((r.text or "").encode(), model.good, model.bad)
        assert abs(got[r.doc_id].score - 1 / (1 + np.exp(-np.clip(model.weight * x + model.bias, -30, 30)))) < 1e-9


def test_quality_learns_from_all_of_a_text():
    text = bytes(range(256)) * 400
    parts = quality.slices(text)
    assert sum(map(len, parts)) == quality.SAMPLE_BYTES and parts[0] == text[:1024] and parts[-1] == text[-1024:]
    assert quality.slices(b"short") == [b"short"] and quality.dictionary([b"", b"ab"]) == b"ab"


def test_quality_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i}") for i in range(60)] + [(7, "both"), (8, None), (9, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (7, 0), (7, 1), (8, 1), (9, 0), (None, 1), (0, 1), (5, 2)], "doc_id long, quality int")
    rows = quality.chosen_rows(docs.unionByName(docs), labels, 10, 3).collect()
    assert len(rows) == 20 and sum(r.quality for r in rows) == 10
    assert {r.text for r in quality.chosen_rows(docs, labels, 100, 3).collect()} == {f"text {i}" for i in range(60)}


# ---------------------------------------------------------------- chat
def test_chat_snapshots(spark):
    base = [("user", "hi"), ("assistant", "hello"), ("user", "more"), (None, None)]
    rows = [(c, k, *base[k]) for c, n in ((1, 2), (2, 4), (3, 4), (4, 1)) for k in range(n)]
    rows += [(5, 0, "user", "other"), (5, 0, "user", "other"), (6, None, "user", "<|im_end|>"), (None, 0, "user", "alone")]
    rows += [(7, k, "user", f"t{k}") for k in range(700)] + [(8, k, "user", f"t{k}") for k in range(650)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int")
    got = defaultdict(list)
    for r in chat.render(d).collect():
        got[r.conv_id].append((r.n_turns, r.text))
    assert set(got) == {2, 5, 6, 7, None} and len(got[7]) == 1 and got[7][0][0] == 700
    assert got[7][0][1] == "".join(f"<|im_start|>user\nt{k}<|im_end|>\n" for k in range(700))
    assert got[2][0][1] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n<|im_start|>unknown\n<|im_end|>\n"
    assert "< |im_end|>" in got[6][0][1] and got[5][0][0] == 1
    assert chat.render(d.limit(0)).count() == 0


_TURN = st.tuples(st.sampled_from([None, 0, 1, 2, 300]), st.sampled_from([None, "user", "bot"]), st.sampled_from([None, "a", "b", "ab"]))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(_TURN, min_size=1, max_size=5), min_size=1, max_size=7))
def test_chat_matches_sql_on_repeated_turns(spark, conversations):
    import duckdb

    rows = [(c, *t) for c, turns in enumerate(conversations) for t in turns]
    schema = "conv_id long, turn long, role string, text string"
    got = sorted(tuple(r) for r in chat.render(spark.createDataFrame(rows, schema)).select("conv_id", "n_turns", "text").collect())
    con = duckdb.connect()
    table = pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(("conv_id", "turn", "role", "text"), (pa.int64(), pa.int64(), pa.string(), pa.string())))})
    con.register("conversations", table)
    assert got == sorted(con.sql(f"SELECT conv_id, n_turns, text FROM ({chat.ORACLE})").fetchall())


def test_chat_very_long_texts(spark):
    rows = [(1, 0, "user", "x" * 3_000_000), (2, 0, "user", "x" * 3_000_000), (2, 1, "bot", "y"), (3, 0, "user", "x" * 2_999_999)]
    got = {r.conv_id: r.n_turns for r in chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {2: 2, 3: 1}


# ---------------------------------------------------------------- pipeline
def test_pipeline_stages(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix_sources", "token_binary"]
    kept = [docs]
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, kept[-1], sf)
        assert out.columns == docs.columns
        kept.append(spark.createDataFrame(out.collect(), docs.schema))
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    roots = brute_components([(r.doc_id, r.text) for r in kept[1].collect()])
    assert ids[2] == {i for i, (_, c) in roots.items() if i == c}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = brute_contamination([(r.doc_id, r.text) for r in kept[2].collect()], bench)
    assert ids[3] == {i for i, v in bad.items() if not v[4]}
    assert ids[4] <= ids[3] and len(ids[1]) >= 0.95 * len(ids[0])
    last = P.STAGES[-1][1](spark, kept[-1], sf)
    assert last.count() == kept[-1].count()
    assert P.run(spark, sf).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


@pytest.mark.parametrize("name", ["op1_decontaminate", "op2_chat_format", "op8_license_scan", "op9_near_dedup"])
def test_oracle(spark, name):
    import duckdb

    from tidemill.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    cols = sorted(want.columns)
    say = lambda x: "NULL" if pd.isna(x) else f"{float(x):.9g}" if isinstance(x, (int, float)) else str(x)
    rows = lambda f: sorted(tuple(map(say, r)) for r in f[cols].astype(object).values.tolist())
    assert rows(got) == rows(want) and sorted(got.columns) == cols


def test_held_out_flags_use_null_safe_ids(odd):
    assert odd.select(F.coalesce(F.expr("pmod(crc32(cast(null as string)), 4) = 2"), F.lit(False))).first()[0] is False
