"""Rows that must be those of the SQL on odd texts, whole texts, and large groups of copies."""

import duckdb
import numpy as np
import pytest

from tidemill.operators import dedup, near
from tidemill.plans import catalog, retrieval  # noqa: F401


def same_as_sql(spark, at, name, rows):
    """The query over documents of these (doc_id, text) and its SQL."""
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{at}/documents.parquet/*.parquet'")
    want = con.sql(catalog.SQL[name])
    got = catalog.QUERIES[name](spark, str(at)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    return {r[0]: r[1:] for r in got.collect()}


def test_policy_of_odd_texts_is_its_sql(spark, tmp_path):
    texts = ["", None, " ", "é123-45-6789", "123-45-6789中", "1.2.3.4١", "ªa@b.co", "a@b.co|", "x123-45-6789", "INTERNAL confİdential", "İnternal CONFIDENTIAL", "password é555-123-4567é"]
    got = same_as_sql(spark, tmp_path, "eval_policy", list(enumerate(texts)))
    assert got[0] == (1.0,) and got[3] == (0.7,) and got[9] == (0.9,)


def test_simhash_hears_all_words(spark, tmp_path):
    """A thousand words of one kind come first, then more of another."""
    texts = ["alpha " * 1000 + "omega " * n for n in (0, 900, 1100, 3500)] + [" ".join(f"word{k % 5003}" for k in range(300_000)), "", None]
    got = same_as_sql(spark, tmp_path, "simhash_md5", list(enumerate(texts)))
    assert got[0] == got[1] != got[2] == got[3]


def clustered(r, n, groups=12):
    """Hashes around a few, up to 14 bits off, and one dense group."""
    base = [int(x) for x in r.integers(0, 1 << 60, groups)]
    off = lambda k: sum(1 << int(b) for b in r.choice(60, k, replace=False))
    near_one = [base[0] ^ off(int(k)) for k in r.integers(0, 5, n // 2)]
    return list(dict.fromkeys(near_one + [base[int(g)] ^ off(int(k)) for g, k in zip(r.integers(0, groups, n), r.integers(0, 15, n), strict=True)]))


@pytest.mark.parametrize("tile", [16, 8192])
def test_near_hashes_by_tiles_are_those_of_brute_force(spark, tile):
    r = np.random.default_rng(11)
    h = clustered(r, 500)
    ids = [int(x) for x in r.permutation(len(h))]
    df = spark.createDataFrame(list(zip(h, ids, strict=True)), "simhash long, id long")
    close = lambda a, b: (a ^ b).bit_count() <= 9
    masks = dedup.near_masks()
    got = sorted(map(tuple, near.pairs(df, masks, 9, tile).collect()))
    assert got == sorted((x, y, (x ^ y).bit_count()) for x in h for y in h if x < y and close(x, y))
    flags = [int(x) for x in r.integers(0, 4, len(h))]
    marked = spark.createDataFrame(list(zip(h, ids, flags, strict=True)), "simhash long, id long, flags int")
    rows = list(zip(h, ids, flags, strict=True))
    want = {i: min((j for y, j, g in rows if g & 1 and j < i and close(x, y)), default=None) for x, i, f in rows if f & 2}
    assert {(a.id, a.first) for a in near.earliest(marked, masks, 9, tile).collect()} == {(i, j) for i, j in want.items() if j is not None}
    leaders, greedy = [], set()
    for i, x in sorted(zip(ids, h, strict=True)):
        first = next((j for j, y in leaders if close(x, y)), None)
        leaders += [(i, x)] if first is None else []
        greedy.add((i, first is None, first))
    for few in (0, 40, 10**6):
        assert {tuple(a) for a in near.resolve(df, masks, 9, few, tile).collect()} == greedy


def test_decisions_take_no_pairs(spark, tmp_path, monkeypatch):
    """Duplicates and leaders come without a row for each near pair."""
    monkeypatch.setattr(near, "pairs", None)
    d = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(200).collect()]
    rows = [(10 * i + k, x if k else x.replace("the", "that")) for i, x in d for k in range(3)]
    for name in ("duplicate_decision", "near_dup_resolved"):
        same_as_sql(spark, tmp_path / name, name, rows)


@pytest.mark.parametrize("tile", [5, 2048])
def test_signature_pairs_are_those_of_brute_force(spark, tile):
    """Signatures are sent to buckets only; a pair comes once, by tiles or whole."""
    r = np.random.default_rng(13)
    base = r.integers(0, 1 << 29, (9, 16))
    sig = [[int(v if r.random() > 0.3 else r.integers(0, 1 << 29)) for v in base[int(g)]] for g in np.minimum(r.integers(0, 16, 120), 8)]
    sig += [list(s[:15]) + [7] for s in sig[:20]]
    df = spark.createDataFrame([(100 + 3 * i, s) for i, s in enumerate(sig)], "id long, signature array<int>")
    agree = lambda x, y: any(x[k : k + 4] == y[k : k + 4] for k in range(0, 16, 4))
    want = [(100 + 3 * i, 100 + 3 * j, sum(a == b for a, b in zip(x, y, strict=True)) / 16) for i, x in enumerate(sig) for j, y in enumerate(sig) if i < j and agree(x, y)]
    got = near.signature_pairs(df, 4, tile)
    assert sorted(map(tuple, got.collect())) == want
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_minhash_pairs_carry_no_signatures_through_joins(spark, tmp_path):
    d = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(150).collect()]
    same_as_sql(spark, tmp_path, "minhash_similarity", [(10 * i + k, x + " extraword" * k + f" tail{i}" * (k // 2)) for i, x in d for k in range(4)])
    s = spark.createDataFrame([(1, [1] * 8), (2, [1] * 4 + [2] * 4)], "doc_id long, signature array<long>")
    p = dedup.minhash_pairs(s, "doc_id")
    assert list(map(tuple, p.collect())) == [(1, 2, 0.5)]
    assert "MapInArrow" in p._jdf.queryExecution().executedPlan().toString()
