import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketry.llm import components, exact_dedup, near_dedup, substring_dedup, textblocks

SCHEMA = "doc_id long, text string, id string, n int, rep string"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed, n=60):
    """Near copies at all distances, copies, shared passages, empty, null and long texts."""
    rnd = random.Random(seed)
    words = [f"w{i}é" for i in range(400)]
    base = [rnd.choices(words, k=rnd.randint(1, 60)) for _ in range(8)]
    shared = rnd.choices(words, k=20)
    texts = []
    for i in range(n):
        own = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 4, 12])):
            own[rnd.randrange(len(own))] = rnd.choice(words)
        if i % 7 == 0:
            at = rnd.randint(0, len(own))
            own[at:at] = shared
        texts.append(rnd.choice([" ", "\n", "\t  "]).join(own))
    texts += [None, "", "  \n ", texts[0], texts[0].upper(), " ".join(rnd.choices(words, k=3000))]
    rnd.shuffle(texts)
    return [(7 * i + 1, t, "x", 1, None) for i, t in enumerate(texts)]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k):
    w = SPACED.findall(lowered(text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def groups(rows, k, percent):
    sets = {r[0]: shingles(r[1], k) for r in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                parent[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, k):
    rows = corpus(k)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), k=k).collect()}
    assert got == groups(rows, k, 80)


def test_words_that_fool_plain_hashes(spark):
    """A long Thue-Morse word and its complement, alike under any polynomial hash of bytes, are different words."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    one, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    rest = " of all that is"
    rows = [(i, t, "x", 1, None) for i, t in enumerate([one, other, one + rest, other + rest, one, f"{one} {one} {one} {one}", f"{other} {one} {one} {one}"])]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), k=4).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0, 5: 5, 6: 6}
    texts = [word_hashes(t) for t in (one, other, "a", "b", "ab", "ba", "abcdefgh", "abcdefghi", "abcdefgh\0", "")]
    assert len(set(texts)) == len(texts)


def word_hashes(text):
    block = next(textblocks.blocks([pa.RecordBatch.from_pydict({"text": [text]})]))
    return tuple(textblocks.Words(block).hashes.tolist())


def test_links_are_confirmed_on_words(spark, monkeypatch):
    """Where hashes of all words are equal, the words still decide (hashes reach this process only)."""
    monkeypatch.setattr(textblocks, "hash_words", lambda data, starts, ends: np.ones(len(starts), np.uint64))
    rows = pa.RecordBatch.from_pydict({"a": [1, 1, 1], "b": [2, 3, 4], "text_a": ["a b c d e f g h"] * 3, "text_b": ["A b c d e f g h", "s t u v w x y z", None]})
    kept = [r for part in near_dedup._overlaps(4, 80)([rows]) for r in part.to_pylist()]
    assert kept == [{"a": 1, "b": 2}]


def test_near_duplicates_of_a_loose_group(spark):
    """Copies that are near each other in part only: the chain through all of them must hold."""
    rnd = random.Random(9)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(80):
        own = list(base)
        for j in rnd.sample(range(80), rnd.choice([0, 1, 2, 3, 4])):
            own[j] = f"e{i}x{j}"
        rows.append((i, " ".join(own), "x", 1, None))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), k=4).collect()}
    assert got == groups(rows, 4, 80)


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    none = near_dedup.near_duplicates(spark.createDataFrame([(1, None, "", 1, ""), (2, "", "", 1, ""), (None, "a b c", "", 1, "")], SCHEMA)).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in none} == {(1, 1, True), (2, 2, True), (None, None, True)}


def test_near_duplicates_with_odd_ids(spark):
    """Null and repeated doc_ids: every row is judged by its own text."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    texts = [(7, a), (7, b), (7, b), (3, b + " tail"), (None, a), (None, c), (None, c + " end"), (9, None), (9, ""), (5, b)]
    rows = [(i, t, "x", 1, None) for i, t in texts]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows,
        SCHEMA)).collect()), key=repr)
    want = [(7, 26, 7, True), (7, 26, 3, False), (7, 26, 3, False), (3, 27, 3, True), (None, 26, 7, False), (9, 0, 9, True), (9, 0, 9, True), (5, 26, 3, False)]
    assert [x for x in got if x[2] is not None] == sorted(want, key=repr)
    assert sorted(x[1:] for x in got if x[2] is None) == sorted([(26, None, True), (27, None, False)]) or sorted(x[1:] for x in got
        if x[2] is None) == sorted([(26, None, False), (27, None, True)])
    kept = near_dedup.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:2]) for r in kept) == [(False, 3, "b0"), (False, 7, "a0"), (False, 9, ""),
        (False, 9, ""), (True, 0, "c0")]
    assert kept[0].__fields__ == [x.split()[0] for x in SCHEMA.split(", ")]


def test_blocks_of_sets():
    """Counted in chunks, as if all sets met."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(600)]
    side = (np.arange(600), np.arange(600) % 7, np.array([len(x) for x in sets]), np.concatenate(sets))
    got = {(int(x[0][i]), int(y[0][j])) for x in near_dedup._chunks(*side) for y in near_dedup._chunks(*side) for i,
        j in zip(*near_dedup._similar(x, y, 70), strict=True)}
    assert got == {(i, j) for i in range(600) for j in range(600) if i % 7 != j % 7
        and 100 * len(np.intersect1d(sets[i], sets[j])) >= 70 * len(np.union1d(sets[i], sets[j]))}
    assert got


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (600, 200, 200))
    sets = [np.unique(np.concatenate((common, x))) for x in (a, b)]
    ends = np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
    sign = near_dedup.circulant_signatures(np.concatenate(sets), ends, 1024)
    assert abs((sign[0] == sign[1]).mean() - 0.6) < 0.06


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(rnd.randrange(100, 160), rnd.randrange(100, 160)) for _ in range(50)] + [(5, 5), (1, 0)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_words_across_documents():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["ab", "", "cd e", None, "x\x0by\x1cz", "ab"])})
    (block,) = textblocks.blocks([batch])
    words = textblocks.Words(block)
    assert np.diff(words.first).tolist() == [1, 0, 2, 0, 2, 1]
    assert words.hashes[0] == words.hashes[-1] and len(set(words.hashes.tolist())) == 5
    at, grams = words.grams(2)
    assert at.tolist() == [1, 3] and len(grams) == 2


def test_exact_duplicates(spark):
    rows = [*corpus(1), (3, "a  b", "", 1, ""), (2, "a\n\tb", "", 1, ""), (9999, "a\x0b b", "", 1, ""), (2, "a b", "", 1, ""), (5, " a b", "", 1, ""),
        (None, "a b", "", 1, ""), (None, "alone", "", 1, ""), (None, "alone", "", 1, "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    for shards in (None, 1):
        got = sorted((tuple(r) for r in exact_dedup.exact_duplicates(frame, shards).collect()), key=repr)
        clean = [re.sub("[\x20\x09-\x0d]+", " ", r[1] or "") for r in rows]
        want = []
        for row, c in zip(rows, clean, strict=True):
            same = [r[0] for r, x in zip(rows, clean, strict=True) if x == c]
            least = min((x for x in same if x is not None), default=None)
            want.append((row[0], least, len(same), row[0] == least, hashlib.sha256(c.encode()).hexdigest()))
        assert got == sorted(want, key=repr)
    assert exact_dedup.exact_duplicates(frame.limit(0)).count() == 0


def test_live_texts(spark):
    rows = corpus(2)
    gone = {r[0] for r in rows if r[0] % 3 == 0}
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.live, r.n_live) for r in exact_dedup.live_texts(frame, F.col("doc_id") % 3 == 0).collect()}
    clean = {r[0]: re.sub("[\x20\x09-\x0d]+", " ", r[1] or "") for r in rows}
    left = [clean[i] for i in clean if i not in gone]
    assert got == {i: (left.count(c) > 0, left.count(c)) for i, c in clean.items()}
    assert any(not x[0] for x in got.values())
    assert all(r.live for r in exact_dedup.live_texts(frame, F.lit(None).cast("boolean")).collect())


def test_texts_combined_in_small_stretches(monkeypatch):
    monkeypatch.setattr(exact_dedup, "HELD_BYTES", 3)
    batch = pa.RecordBatch.from_pydict({"digest": [b"1" * 32, b"1" * 32, b"2" * 32], "text": ["ab", "ab", "cd"], "doc_id": [4, None, 1],
        "gone": [False, True, False]})
    sent = list(exact_dedup._combined([batch, batch]))
    assert len(sent) == 2 and sent[0].to_pylist()[0] == {"digest": b"1" * 32, "text": "ab", "least": 4, "n": 2, "gone": 1}
    live = pa.Table.from_batches(exact_dedup._indexed(sent)).to_pylist()
    assert sorted((x["least"], x["n"]) for x in live) == [(1, 2), (4, 2)]


@pytest.mark.parametrize("bits", [256, 4])
def test_cuckoo_index(bits):
    """Also with digests that hardly tell texts apart: the stored texts decide."""
    index, rnd = exact_dedup.CuckooIndex(2), random.Random(2)
    live = {}
    for i in range(3000):
        text = str(rnd.randrange(300))
        digest = hashlib.sha256(text.encode()).digest()
        digest = digest if bits == 256 else bytes([digest[0] & 15]) * 32
        if rnd.random() < 0.3:
            assert index.delete(digest, text) == (live.pop((digest, text), None) is not None)
        else:
            index.put(digest, text, i)
            live[digest, text] = i
        assert index.live == len(live)
    assert {x[:2]: x[2] for x in index.items()} == live and all(index.get(*k) == v for k, v in live.items())
    assert index.get(b"\0" * 32, "gone") is None
    clash = [(b"\1\0" + bytes(8) + bytes([i]) * 22, "same") for i in range(8)]  # one fingerprint and bucket pair
    for i in range(12):
        index.put(clash[0][0], f"text {i}", i)
    assert [index.get(clash[0][0], f"text {i}") for i in range(12)] == list(range(12))
    assert index.buckets < 5000


@pytest.mark.parametrize("size", [13, 6])
def test_repeats(spark, size):
    rows = corpus(5, 120)
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), size=size, texts=True).collect()}
    words = {r[0]: SPACED.findall(r[1] or "") for r in rows}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][j : j + size]), i)
    removed = 0
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - size + 1):
            if first[tuple(w[j : j + size])] < i:
                gone[j : j + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_text) == (len(w), sum(gone), kept)
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        assert sorted(p for s in r.repeats for p in range(s.begin, s.end)) == [p for p, g in enumerate(gone) if g]
        removed += sum(gone)
    assert removed > 200
    assert substring_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("held", [5, 1 << 20])
def test_repeats_of_odd_rows(spark, monkeypatch, held):
    """Repeated and null ids, and entries that leave a task early (``held`` reaches tasks in this module's own workers only)."""
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(50)]
    shared = [rnd.choices(words, k=30) for _ in range(3)]
    rows = []
    for i in range(60):
        own = rnd.choices(words, k=rnd.randint(0, 30))
        for _ in range(rnd.choice([0, 1, 2])):
            piece, at = rnd.choice(shared), rnd.randint(0, len(own))
            own[at:at] = piece[rnd.randint(0, 5) : rnd.randint(20, 30)]
        rows.append((rnd.choice([i, i // 4, None]), rnd.choice([" ", "\n ", "\t"]).join(own), "x", 1, None))
    named = [r for r in rows if r[0] is not None]
    windows = {}
    for doc, text, *_ in named:
        own = text.split()
        for j in range(len(own) - 6):
            windows.setdefault(tuple(own[j : j + 7]), set()).add(doc)
    want = []
    for doc, text, *_ in rows:  # a row without doc_id comes after all that have one
        own = text.split()
        gone = {p for j in range(len(own) - 6) if min(windows.get(tuple(own[j : j + 7]), [1000])) < (999 if doc is None else doc) for p in range(j, j + 7)}
        want.append((doc, len(own), len(gone), " ".join(x for p, x in enumerate(own) if p not in gone)))
    assert sum(w[2] > 0 for w in want if w[0] is None) > 2
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(len(named))), "doc_id": pa.array([r[0] for r in named]), "text": pa.array([r[1] for r in named])})
    monkeypatch.setattr(substring_dedup, "HELD", held)
    monkeypatch.setattr(textblocks, "BLOCK_BYTES", 200)
    sent = [r for part in substring_dedup._anchors(3, 5)([batch]) for r in part.to_pylist()]
    assert {r["known"] for r in sent} == {True, False} and len(sent) > 100
    size = {True: 0, False: 0}
    listed = {r["id"]: sorted(x["at"] for x in sent if x["id"] == r["id"]) for r in sent}
    rows_ = batch.append_column("anchors", pa.array([listed.get(i) for i in range(len(named))], pa.list_(pa.int32())))
    for r in (r for part in substring_dedup._windows(7, 3)([rows_]) for r in part.to_pylist()):
        assert (r["src"] is None) == (r["hashes"] is not None) and r["run"] == (len(r["hashes"]) if r["hashes"] else r["run"]) > 0
        own, known = named[r["id"]][1].split(), r["src"] is not None
        assert not known or named[r["src"]][0] < named[r["id"]][0]
        if known:
            assert own[r["at"] : r["at"] + r["run"] + 6] == named[r["src"]][1].split()[r["src_at"] : r["src_at"] + r["run"] + 6]
        size[known] += r["run"]
    assert size[False] > 100 and size[True] > (5 if held < 9 else 100)
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), size=7, seed=3, texts=True).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == sorted(want, key=repr)


def test_refuted_matches_stay():
    """A match whose words the source does not have is found out, and its words stay."""
    docs = pa.RecordBatch.from_pydict({"id": [1, 2], "doc_id": [1, 2], "named": [1, 2], "text": ["a b c d e f g h", "x b c d e f q"]})
    kind = pa.list_(pa.struct([("places", pa.int64()), ("src", pa.int64()), ("run", pa.int64())]))
    for entries in ([(0, 3)], [(i << 32 | i, 1) for i in range(3)], [(0, -0b111)], [(0, -0b101), (1 << 32 | 1, 1)]):
        refute(docs, docs.append_column("windows", pa.array([None, [{"places": p, "src": 1, "run": r} for p, r in entries]], kind)))


def refute(docs, matched):
    claims = [r for part in substring_dedup._claims(4)([matched]) for r in part.to_pylist()]
    assert [(r["id"], r["src"], r["src_begin"], r["n"]) for r in claims] == [(2, 1, 0, 6)]  # one of six words from "x" on: the source says "a"
    entry = pa.list_(pa.struct([("src_begin", pa.int32()), ("n", pa.int32()), ("digest", pa.binary())]))
    own = [{k: r[k] for k in ("src_begin", "n", "digest")} for r in claims]
    true = {"src_begin": 1, "n": 2, "digest": hashlib.sha256(b"b c").digest()}
    asked = docs.append_column("claims", pa.array([[*own, true], None], entry))
    refuted = [r for part in substring_dedup._refuted([asked]) for r in part.to_pylist()]
    assert refuted == [{k: claims[0][k] for k in ("src", "src_begin", "n", "digest")}]
    entry = pa.list_(pa.struct([("src", pa.int64()), ("src_begin", pa.int32()), ("n", pa.int32()), ("digest", pa.binary())]))
    for said, left in ((None, "q"), (refuted, "x b c d e f q")):
        rows = matched.append_column("refuted", pa.array([None, said], entry))
        out = [r for part in substring_dedup._repeats(4, True)([rows]) for r in part.to_pylist()]
        assert [r["kept_text"] for r in out] == ["a b c d e f g h", left]
