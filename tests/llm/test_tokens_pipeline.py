import random
import zlib

import numpy as np
import pytest

from basketry.llm import token_store as ts
from basketry.llm.queries import tokenizer_path


@pytest.mark.parametrize("bits", [1, 5, 16, 20])
def test_wavelet_matrix(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        kind = np.uint16 if bits <= 16 else np.uint32
        x = (rng.integers(0, 2**bits, n) * (rng.random(n) < 0.7)).astype(kind)
        w = ts.WaveletMatrix.from_bytes(ts.WaveletMatrix.build(x, bits).to_bytes())
        assert (w.all() == x).all() and w.size == n
        assert (w.access(np.arange(n)) == x).all()
        for v in {0, 2**bits - 1, *x[:20].tolist(), 2**bits + 3}:
            at = np.flatnonzero(x == v)
            assert w.count(v) == len(at) and w.occurrences(v)[:5] == at[:5].tolist()
            assert w.select(v, len(at)) == -1
            for a, b in ((0, n // 2), (n // 3, n)):
                assert w.rank(v, b, a) == int((x[a:b] == v).sum())
    with pytest.raises(ValueError):
        ts.WaveletMatrix.from_bytes(b"nope")


def test_access_opens_one_frame_a_plane(monkeypatch):
    monkeypatch.setattr(ts, "FRAME", 4)
    x = np.random.default_rng(0).integers(0, 2**16, 5000).astype(np.uint16)
    stored = ts.WaveletMatrix.build(x, 16).to_bytes()
    for at in (0, 77, 4999):
        w = ts.WaveletMatrix.from_bytes(stored)
        assert w.access([at])[0] == x[at] and all(len(p.open) == 1 for p in w.planes)
    w = ts.WaveletMatrix.from_bytes(stored)
    value = int(x[1234])
    places = np.flatnonzero(x == value)
    assert w.occurrences(value) == places.tolist() and w.rank(value, 3000, 1000) == ((places >= 1000) & (places < 3000)).sum()
    assert (w.all() == x).all()


def odd_texts():
    rnd = random.Random(1)
    pieces = ["Hello", "don't", "it's'll", "<|startoftext|>", "<|endoftext|>x", "Ünïcode", "ΣΑΣ", "İstanbul", "e\u0301", "中文字", "a1b22", "😀!",
        "x\u00a0y", "\u2003", "a\x1cb", "tab\tnl\n", "...!!", "ß", "ŒUVRE", "1/2", "|", "÷×", "\ufeff", "’s", "ﬁ", "_x_"]
    return [None, "", " \n", "a" * 5000, *pieces, *[rnd.choice([" ", "", "\n"]).join(rnd.choices(pieces, k=12)) for _ in range(200)]]


def test_encoder_is_the_library():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    encoder = ts._Encoder(tokenizer_path())
    for text in odd_texts()[1:]:
        want = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), np.uint16).tolist() == want, repr(text)


def test_tokens_round_trip(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(ts, "SHARD_IDS", 300)
    whole = Tokenizer.from_file(tokenizer_path())
    texts = odd_texts()
    rows = [(3 * i - 7, t, "p", 1) for i, t in enumerate(texts)] + [(2, "tie b", "p", 1), (2, "tie a", "p", 1), (2, "tie a", "p", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string, shard int").repartition(3)
    got = ts.tokenized(docs, tokenizer_path()).orderBy("start").collect()
    start = 0
    for r, row in zip(got, sorted(rows, key=lambda x: (x[0], x[1] is not None, x[1] or "")), strict=True):
        ids = np.array([*whole.encode(row[1] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (row[0], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert ts.tokenized(docs.limit(0), tokenizer_path()).count() == 0


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(3)
    words = ["stone", "river", "maple", "cloud", "ember", "frost", "grain", "haven", "inlet", "jewel", "knoll", "lemon"]
    words += [a + b for a in words for b in words]
    item = " ".join(rnd.choices(words, k=20))
    texts = [" ".join(rnd.choices(words, k=60)) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 3}", len(t), 7) for i, t in enumerate(texts)]
    rows += [(100, texts[0], "en", "s0", 1, 7), (101, texts[1] + " tail", "en", "s1", 1, 7), (102, "123 !!", "en", "s0", 1, 7),
        (103, None, None, None, None, None), (104, item, "en", "s1", 1, 7)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, passes int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert len(pipeline.STAGES) == 5
    kept = {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        kept[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
        if name != "token_output":
            assert docs.columns == schema.replace(",", "").split()[::2]
    clean = list(range(40))
    assert kept["language_id"] == [*clean, 100, 101, 104]
    assert kept["near_dedup"] == [*clean, 104] and kept["decontamination"] == clean
    assert set(kept["mixture"]) <= set(clean) and 1.4 * 40 <= len(kept["mixture"]) <= 1.6 * 40
    assert kept["token_output"] == kept["mixture"]
    assert pipeline.run(spark, str(tmp_path)).count() == len(kept["mixture"])


def test_pipeline_languages(spark):
    """Foreign scripts go, labelled or not; clean texts of one word stay."""
    pipeline = pytest.importorskip("corpus_pipeline")
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()
    rnd = random.Random(5)
    scripts = [(0x3B1, 0x3C9), (0x430, 0x44F), (0x3042, 0x3093), (0x4E00, 0x9000), (0x627, 0x64A), (0xAC00, 0xD000), (0x915, 0x939), (0xE01, 0xE2E)]
    foreign = [" ".join("".join(chr(rnd.randint(a, b)) for _ in range(rnd.randint(2, 8))) for _ in range(n)) for a, b in scripts for n in (1, 5, 60, 300)]
    rows = [(r.doc_id, r.text, r.lang) for r in given]
    rows += [(10_000 + i, t, [None, "en", "fr"][i % 3]) for i, t in enumerate(foreign)]
    rows += [(20_000, "Avec.", "fr"), (20_001, "Avec.", None), (20_002, "The", None), (20_003, "und", "de"), (20_004, "12 3!", "en"), (20_005, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in pipeline.language_id(spark, docs, "").collect()}
    assert kept == {r.doc_id for r in given} | {20_000, 20_001, 20_002, 20_003}
    assert pipeline.language_id(spark, docs.limit(0), "").count() == 0
    lone = spark.createDataFrame([(1, "Avec.", "fr"), (2, "ξένο κείμενο", None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in pipeline.language_id(spark, lone, "").collect()] == [1]


def test_pipeline_of_odd_tables(spark, tmp_path):
    """No row is lost or multiplied by null or repeated ids, extra columns of any name stay, and empty tables pass through."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(8)
    words = [a + b for a in ("stone", "river", "maple", "cloud", "ember", "frost") for b in ("grain", "haven", "inlet", "jewel", "knoll")]
    item = " ".join(rnd.choices(words, k=15))
    own = [" ".join(rnd.choices(words, k=50)) for _ in range(12)]
    rows = [(i, t, "en", "s") for i, t in enumerate(own[:6])] + [(None, t, "en", None) for t in own[6:9]]
    rows += [(5, own[5], "en", "s"), (5, own[9], "en", "s"), (None, own[6], "en", "s"), (None, item, "en", "s"), (3, item + " x", "en", "s"),
        (7, "", "en", "s"), (None, None, None, None)]
    rows = [(*r, 1, "p", 2, "k") for r in rows]
    schema = "doc_id long, text string, lang string, source string, copy_of_pass int, row string, passes int, id string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [x.split()[0] for x in schema.split(", ")]
        texts = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in docs.collect()), key=repr)
        if name == "language_id":
            assert len(texts) == len(rows) - 2
        if name == "near_dedup":
            assert sorted(t for _, _, t in texts) == sorted([*own[:10], item + " x"])
        if name == "decontamination":
            assert sorted(t for _, _, t in texts) == sorted(own[:10])
    assert 13 <= len(texts) <= 17 and {t for _, _, t in texts} <= set(own[:10])
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
