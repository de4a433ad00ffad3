"""Source divergence, byte-level BPE and exact k-means against plain versions of the same rules."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from basketry.llm import bpe, centroids, divergence
from basketry.llm.queries import BYTE_TOKENIZER, op12_byte_bpe, tokenizer_path

SF = "/root/testdata/sf0.001"


# --- source divergence ------------------------------------------------------


def plain_divergence(rows, least, top):
    docs = defaultdict(list)
    for lang, source, text in rows:
        words = re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode().lower())
        docs[lang or ""].append((source or "", [w.decode() for w in words]))
    out = []
    for lang, own in docs.items():
        df = Counter(t for _, w in own for t in set(w))
        kept = {t for t, n in df.items() if n >= least}
        counts = {s: Counter() for s, _ in own}
        for s, w in own:
            counts[s].update(t for t in w if t in kept)
        whole = sum(counts.values(), Counter())

        def p(c, t):
            return 1 + 10**9 * (c[t] + 5) // (c.total() + 5 * len(kept))  # noqa: B023

        for s, c in counts.items():
            pairs = [(sum(abs(p(c, t) - p(d, t)) for t in kept), r) for r, d in counts.items() if r != s]
            terms = [(p(c, t) - p(whole, t), t) for t in c if p(c, t) > p(whole, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(found, 1) if part == "pair" or i <= top]
    return sorted(out)


def divergence_rows(spark, rows, least, top):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, n int, docs string")
    got = divergence.divergence(table.repartition(3), least, top)
    return sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect()))


def test_divergence_is_the_plain_sum(spark, monkeypatch):
    rnd = random.Random(3)
    vocabulary = ["the", "The", "é", "É", "été", "ß", "中文", "a1b", "x-y", "İ", "don't", "zz", " ", "_"]
    rows = []
    for _ in range(300):
        lang, source = rnd.choice(["en", "en", "fr", "", None]), rnd.choice(["s1", "s1", "s1", "s2", "s3", "", None, "é"])
        rows.append((lang, source, rnd.choice([None, "", "1 2", *[" ".join(rnd.choices(vocabulary, k=rnd.randrange(1, 40))) for _ in range(8)]])))
    rows += rows[:20] + [("xx", "only", "word"), ("yy", "a", None), ("yy", "b", "1"), ("en", "long", "word " * 300_000)]
    want = plain_divergence(rows, 4, 5)
    assert divergence_rows(spark, rows, 4, 5) == want and len(want) > 60
    # small limits: counts are sent on often, trees are settled often, long texts are cut often
    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence, "NODES", 4)
    monkeypatch.setattr(divergence, "SLICE", 7)
    assert divergence_rows(spark, rows[:-1], 4, 5) == plain_divergence(rows[:-1], 4, 5)


def test_divergence_of_nothing(spark):
    assert divergence_rows(spark, [], 1, 5) == []
    assert divergence_rows(spark, [("en", "a", None), ("en", "b", "")], 1, 5) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_pattern_tree_shares_beginnings():
    tree = divergence.PatternTree()
    for row, times in (([1, 2, 3], 2), ([1, 2, 4], 1), ([1, 3], 5), ([2], 7)):
        tree.insert(row, times)
    assert len(tree.parent) == 6
    found = Counter()
    for x, y, n in tree.pairs():
        for a, b, k in zip(x.tolist(), y.tolist(), n.tolist(), strict=True):
            found[a, b] += k
    assert found == {(2, 1): 3, (3, 2): 2, (3, 1): 7, (4, 2): 1, (4, 1): 1}
    assert sum(len(x) for x, _, _ in tree.pairs()) == 6  # once for a node and ancestor, however many rows


# --- byte-level BPE ---------------------------------------------------------


def strange_texts(n):
    rnd = random.Random(11)
    pieces = ["Hello", "don't", "it's'll", "<|endoftext|>", "<|endo", "  ", "\n\n", "\t", " ", " ", "\x1c", "\x85", "中文字", "İß", "😀", "é",
        "՘", "\U00011de0", "123", "½", "_-_", "'S", "’s", "x" * 300, "ab" * 700, "﻿", "a\x00b", "�"]
    for _ in range(n):
        any_letter = lambda: chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x80, 0xD800), rnd.randrange(0xE000, 0x110000)]))
        yield "".join(rnd.choice(pieces) if rnd.random() < 0.6 else any_letter() for _ in range(rnd.randrange(12)))


def test_bpe_is_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path(BYTE_TOKENIZER)
    own, library = bpe.Bpe(path), Tokenizer.from_file(path)
    for text in ["", " ", *strange_texts(3000)]:
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == want, repr(text)
        assert own.decode(want) == library.decode(want, skip_special_tokens=False) == text
    rnd = random.Random(2)
    for _ in range(300):  # ids that no text gives, cut characters among them
        ids = [rnd.randrange(50_257) for _ in range(rnd.randrange(9))]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_arrays_heap_and_scan_part_alike(monkeypatch):
    own = bpe.Bpe(tokenizer_path(BYTE_TOKENIZER))
    rnd = random.Random(7)
    for n in [1, 2, 3, 5, 17, 100, 256, 257, 2000]:
        for word in (bytes(rnd.choice(b"aabetn ") for _ in range(n)), b"a" * n, ("é" * n).encode()[:n]):
            bounds = own._scanned(word)
            assert own._heaped(word) == bounds
            assert own._arrays([word, b"a", word]) == [[own.ids[word[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)], [own.ids[b"a"]],
                [own.ids[word[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]]
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    monkeypatch.setattr(bpe, "PIECES", 2)
    small = bpe.Bpe(own.path)
    texts = [*strange_texts(200)]
    assert small.encode_all(texts) == [own.encode(text) for text in texts]


def test_bpe_query(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(BYTE_TOKENIZER))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op12_byte_bpe(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(back))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_bpe_of_odd_rows(spark, monkeypatch):
    path = tokenizer_path(BYTE_TOKENIZER)
    rows = [(1, None, "a"), (1, "", "b"), (None, "hello world", "c"), (None, "hello world", None), (3, "word " * 200_000, "e")]
    table = spark.createDataFrame(rows, "doc_id long, text string, `the part` string")
    ids = bpe.encoded(table, path)
    assert ids.columns == ["doc_id", "the part", "ids"]
    back = bpe.decoded(ids, path)
    assert sorted(map(tuple, back.select("doc_id", "text", "the part").collect()), key=repr) == sorted(((i, t or "", p) for i, t, p in rows), key=repr)
    assert bpe.encoded(table.limit(0), path).count() == 0
    with pytest.raises(ValueError):
        bpe.encoded(ids.withColumnRenamed("the part", "text"), path)
    with pytest.raises(ValueError):
        bpe.decoded(back, path)
    with pytest.raises(ValueError):
        bpe.Bpe(tokenizer_path())  # a vocabulary of another kind


# --- k-means ----------------------------------------------------------------


def plain_clusters(rows, k, rounds):
    x = [(i, [int(np.floor(256 * float(np.float32(e)))) for e in v]) for i, v in rows if v is not None and len(v) == 3 and None not in v
        and np.isfinite(np.float32(v)).all()]
    start = sorted(x, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in start[:k]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, m, strict=True)) for m in c]
        return min((e, i) for i, e in enumerate(d))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in x]
        c = [[sum(v[j] for (_, v), o in zip(x, own, strict=True) if o == i) // own.count(i) for j in range(3)] if i in own else m for i, m in enumerate(c)]
    found = [(i, *nearest(v)[::-1]) for i, v in x]
    each = defaultdict(int)
    for _, i, d in found:
        each[i] += d
    return sorted(((v, i, d, each[i], sum(each.values()), sha(",".join(map(str, c[i])))) for v, i, d in found), key=repr)


@pytest.mark.parametrize(("n", "k", "spread"), [(400, 7, 1.0), (400, 12, 0.01), (60, 5, 3000.0), (3, 5, 1.0), (0, 4, 1.0), (50, 1, 1.0)])
def test_clusters_are_the_plain_ones(spark, n, k, spread):
    rnd = np.random.default_rng(n + k)
    rows = [(int(i) if i % 9 else None, (rnd.normal(0, spread, 3) + rnd.integers(0, 4) * spread).tolist()) for i in range(n)]
    rows += rows[: n // 4] + [(-5, None), (-6, [1.0]), (-7, [1.0, None, 2.0]), (-8, [1.0, float("nan"), 2.0]), (-9, [1.0, float("-inf"), 2.0]), (-10, [])]
    table = spark.createDataFrame([(i, v, "extra") for i, v in rows], "vec_id long, embedding array<float>, cluster string").repartition(3)
    got = centroids.clusters(table, k=k, rounds=4, dims=3)
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert got.columns == names
    assert sorted(map(tuple, got.collect()), key=repr) == plain_clusters(rows, k, 4)


def test_too_large_components_are_refused(spark):
    table = spark.createDataFrame([(1, [1e6, 0.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="beyond a long"):
        centroids.clusters(table, k=1, dims=2).collect()


def test_bounds_hold_and_spare_work():
    """No row that the bounds settle has another nearest centroid; most rows need no scan; total displacement is under the summed drifts."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(-40, 40, (300, 8)) + 200 * i for i in range(6)]).astype(np.int64)
    history = [x[rng.permutation(len(x))[:12]]]
    state = [np.full(len(x), -1), *(np.zeros(len(x), np.int64) for _ in range(4))]
    spared = 0
    for _ in range(8):
        bounds = centroids.NsBounds(history)
        if len(history) > 1:
            sure = bounds.settled(*state)
            spared += sure.sum()
            d = ((x[:, None, :] - history[-1][None]) ** 2).sum(2)
            assert (d.argmin(1)[sure] == state[0][sure]).all()
            drifts = sum(np.sqrt(((a - b) ** 2).sum(1)) for a, b in zip(history, history[1:], strict=False))
            assert (bounds.moved[0] <= drifts + 1e-9).all()
        state = bounds.assign(x, state, exact=False)
        assert (state[0] == ((x[:, None, :] - history[-1][None]) ** 2).sum(2).argmin(1)).all()
        history.append(np.stack([x[state[0] == c].sum(0) // (state[0] == c).sum() if (state[0] == c).any() else history[-1][c] for c in range(12)]))
    assert spared > 0.5 * 7 * len(x)
