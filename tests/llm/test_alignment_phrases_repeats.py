"""Operators 11 to 13 against brute force, and on odd rows."""

import collections
import hashlib
import random
import re

import pytest

from tidemill.llm.alignment import PieceTokens, Table, _byte_level, aligned, default_pieces
from tidemill.llm.collocations import collocations, pack, radix_order, unpack
from tidemill.llm.repeats import repeats
from tidemill.llm.tokens import default_tokenizer


def rows(df, n=None):
    return sorted((tuple(r)[:n] for r in df.collect()), key=str)


# ---------------------------------------------------------------- 11
def brute_alignment(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(default_tokenizer()), sentencepiece.SentencePieceProcessor(model_file=default_pieces())
    a_model.encode_special_tokens = True
    code = _byte_level()
    b_bytes = lambda i: bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()
    per, count = [], collections.Counter()
    for i, t in docs:
        per.append((i, None))
        if not t:
            continue
        a, b, raw = a_model.encode(" " + t, add_special_tokens=False).ids, b_model.encode(t), (" " + t).encode()
        x, y = [bytes(code[c] for c in a_model.id_to_token(k)) for k in a], [b_bytes(k) for k in b]
        if b"".join(x) != raw or b"".join(y) != raw:
            continue
        ends = lambda z: [sum(map(len, z[: k + 1])) for k in range(len(z))]
        x, y = ends(x), ends(y)
        p = q = 0
        groups, links = [], []
        for e in sorted({*x} & {*y}):
            p2, q2 = x.index(e) + 1, y.index(e) + 1
            groups.append(",".join(map(str, a[p:p2])) + "|" + ",".join(map(str, b[q:q2])))
            links.append((a[p2 - 1], b[q2 - 1]))
            p, q = p2, q2
        count.update(links)
        per[-1] = (i, (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return sorted(((i, 0, 0, 0, 0, 0, 0, "") if x is None else (i, *x[:3], len(x[3]), sum(count[k] == most[k[1]] for k in x[3]), sum(count[k] for k in x[3]), x[4]) for i, x in per), key=str)


@pytest.mark.parametrize("bound", [1 << 21, 200, 0])
def test_alignment_brute_force(spark, bound):
    r = random.Random(2)
    letters = "abc ABC  éü漢😀\n\t.,;<|endoftext|>\x00 ́١½▁0123456789"
    docs = [(i, "".join(r.choice(letters) for _ in range(r.randint(0, 60)))) for i in range(200)]
    docs += [(900, None), (901, ""), (902, " "), (903, "  "), (904, "a  b  "), (905, "<|endoftext|> x<s></s><unk>"), (906, "▁a ▁"), (907, " a\n b"), (907, " a\n b"), (None, "x y"), (908, "\n\n  \n x"), (909, "mit der Hand " * 200)]
    assert rows(aligned(spark.createDataFrame(docs, "doc_id long, text string"), bound=bound)) == brute_alignment(docs)


def test_alignment_of_odd_rows(spark, odd, nothing):
    assert aligned(nothing).count() == 0
    got = aligned(odd, groups=True)
    assert got.count() == odd.count()
    by = {r.doc_id: r for r in got.collect()}
    assert by[3].n_a == by[4].n_b == 0 and by[3].groups_sha256 == ""
    assert by[6].groups.count(";") == by[6].n_groups - 1 and hashlib.sha256(by[6].groups.encode()).hexdigest() == by[6].groups_sha256


def test_words_encode_as_whole_texts():
    coder = PieceTokens(default_pieces())
    assert coder.wordwise
    texts = ["a  b ", "  x", " ", "   ", "one two\nthree  four\t five ", "", "é ü😀 ▁ ▁▁", "x" * 500 + " y"]
    assert coder.encode(texts) == coder.encode(texts) == [coder.whole([t])[0] if t else b"" for t in texts]


def test_bytes_of_ids():
    import numpy as np

    t = Table([b"ab", b"", b"c"])
    assert t.joined(np.array([2, 1, 0, 2])).tobytes() == b"cabc" and t.joined(np.empty(0, np.int64)).tobytes() == b""


# ---------------------------------------------------------------- 12
def brute_phrases(docs, least, top, share):
    n, f = collections.Counter(), collections.Counter()
    for lang, t in docs:
        lang = "und" if lang is None else lang
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    longer = collections.Counter()
    for (lang, w), v in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(longer[lang, w[i : i + k]], v)
    out = collections.defaultdict(list)
    for (lang, w), a in found.items():
        if 100 * longer[lang, w] < share * a or (lang, w) not in longer:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted(((lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, v in out.items() for i, x in enumerate(sorted(v)[:top])), key=str)


@pytest.mark.parametrize("least,top,share,bound", [(20, 2000, 100, 1 << 20), (5, 50, 100, 0), (10, 30, 80, 1 << 20)])
def test_phrases_brute_force(spark, least, top, share, bound):
    r = random.Random(1)
    words = ["".join(r.choice("abcdéEfghij\x01") for _ in range(r.randint(1, 4))) for _ in range(40)]
    docs = [(r.choice(["en", "fr", None, "und"]), "".join(r.choice(words[: r.randint(1, 40)]) + r.choice([" ", " ", "  ", "\t", ". ", ", ", "\n", " "]) for _ in range(r.randint(0, 200)))) for _ in range(300)]
    docs += [("en", None), (None, ""), ("fr", " .. ")]
    assert rows(collocations(spark.createDataFrame(docs, "lang string, text string"), least, 5, top, share, bound)) == brute_phrases(docs, least, top, share)


def test_phrases_of_odd_rows(spark, odd, nothing):
    assert collocations(nothing).count() == 0
    assert rows(collocations(odd, least=2)) == brute_phrases([(r.lang, r.text) for r in odd.collect()], 2, 2000, 100)


def test_large_counts_are_exact(spark):
    """The score's products pass 64 bits in a corpus of 10^13 words."""
    exact = "(cast(1000 as decimal(38, 0)) * a * n) div (cast(l as decimal(38, 0)) * r)"
    a, n, l, r = 9_999_999_999_877, 9_999_999_999_999_937, 10_000_000_000_017, 9_999_999_999_923
    assert spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long").selectExpr(exact).first()[0] == 1000 * a * n // (l * r)


def test_keys_sort_like_their_bytes():
    import numpy as np

    r = np.random.default_rng(1)
    for width, high in ((2, 1 << 16), (3, 1 << 24), (4, 1 << 32)):
        ids = [r.integers(0, high, 500, dtype=np.uint64).astype(np.uint32) for _ in range(3)]
        ids[0][:] = ids[0] % 7
        keys = pack(ids, width)
        assert all((x == y).all() for x, y in zip(unpack(keys, width), ids))
        assert [keys[k].as_py() for k in radix_order(ids, width)] == sorted(keys.to_pylist())


# ---------------------------------------------------------------- 13
def brute_repeats(docs, length):
    count = collections.Counter()
    texts = [(i, (t or "").encode()) for i, t in docs]
    for _, b in texts:
        count.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone) if not y)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length,core,limit", [(200, 48, 1 << 19), (200, 48, 3000), (40, 12, 500)])
def test_repeats_brute_force(spark, length, core, limit):
    """With small limits the segments of the passage that 60 texts share are split, down to single strings."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdéfg hij") for _ in range(r.randint(1, 9))) for _ in range(60)]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    lines = [some(r.randint(3, 60)) for _ in range(30)]
    docs = [(i, " ".join(r.choice(lines) if r.random() < 0.4 else some(20) for _ in range(r.randint(0, 10)))) for i in range(80)]
    docs += [(500, None), (501, ""), (502, "word " * 300), (503, "word " * 301), (504, "a" * 500), (505, docs[3][1]), (505, docs[3][1]), (None, docs[4][1])]
    hot = some(60)
    docs += [(1000 + i, f"{some(30)} {hot} {some(30)}") for i in range(60)]
    assert rows(repeats(spark.createDataFrame(docs, "doc_id long, text string"), length, core, limit=limit), 5) == brute_repeats(docs, length)


def test_repeats_of_odd_rows(spark, odd, nothing):
    assert repeats(nothing).count() == 0
    got = repeats(odd, 40, 12, texts=True)
    assert rows(got.drop("spans", "kept")) == brute_repeats([(r.doc_id, r.text) for r in odd.collect()], 40)
    for r in got.collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.kept.encode()) <= r.n_bytes - r.n_removed
    with pytest.raises(ValueError):
        repeats(odd, 400, 48)
