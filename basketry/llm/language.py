"""Language ID by hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
#: More names than there are languages.
MOST_LANGUAGES = 20_000
#: Characters of a batch of documents that are bundled together.
BATCH_CHARS = 1 << 18
_LETTERS: dict[tuple[int, int], np.ndarray] = {}
_KIND = np.full(0x110000, -1, np.int8)  # of a code point: 1 letter, 0 other, -1 not looked up


def _letter(code: int, dims: int) -> np.ndarray:
    """The random bipolar vector of a letter; code 0 is whatever stands between words."""
    have = _LETTERS.get((code, dims))
    if have is None:
        have = np.random.Generator(np.random.PCG64([7919, code])).integers(0, 2, dims, np.int8) * np.int8(2) - np.int8(1)
        _LETTERS[code, dims] = have
    return have


def _trigram_vectors(a: np.ndarray, b: np.ndarray, c: np.ndarray, codes: np.ndarray, dims: int) -> np.ndarray:
    """Bind each trigram's letters, permuted (rotated) by their place in it."""
    table = np.stack([_letter(int(x), dims) for x in codes])
    return (np.roll(table, 2, axis=1)[a] * np.roll(table, 1, axis=1)[b] * table[c]).astype(np.float32)


@dataclass
class Bundles:
    """Trigram counts of a batch of documents: ``counts[i, j]`` of document i and trigram j."""

    counts: np.ndarray
    parts: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    letters: np.ndarray


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, 0 for what is no letter, and where each text begins."""
    low = [f" {x.lower()} " for x in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    first = np.concatenate(([0], np.cumsum([len(x) for x in low])))
    kinds = _KIND[codes]
    if (kinds < 0).any():
        for x in np.unique(codes[kinds < 0]):
            _KIND[x] = chr(x).isalpha()
        kinds = _KIND[codes]
    return np.where(kinds == 1, codes, 0), first


def bundled(texts: list[str], dims: int) -> Bundles:
    """Count the distinct letter trigrams of each text; a run of other characters is one space."""
    codes, first = _codes(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    letters = np.bincount(doc[codes > 0], minlength=len(texts))
    keep = np.concatenate(([True], (codes[1:] > 0) | (codes[:-1] > 0) | (doc[1:] != doc[:-1])))
    codes, doc = codes[keep], doc[keep]
    alphabet, own = np.unique(codes, return_inverse=True)
    s = len(alphabet)
    whole = np.flatnonzero((doc[2:] == doc[:-2]) & (codes[1:-1] > 0)) if len(codes) > 2 else np.zeros(0, np.int64)
    tri = (own[whole] * s + own[whole + 1]) * s + own[whole + 2]
    kinds, place = np.unique(tri, return_inverse=True)
    counts = np.bincount(doc[whole] * len(kinds) + place, minlength=len(texts) * len(kinds)).reshape(len(texts), len(kinds)).astype(np.float32)
    return Bundles(counts, (kinds // (s * s), kinds // s % s, kinds % s, alphabet), letters)


def _batches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        sizes = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), np.int64)) if batch.num_rows else []
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + BATCH_CHARS, "right")))
            to = min(to, at + 512)
            yield batch.slice(at, to - at), [x or "" for x in texts.slice(at, to - at).to_pylist()]
            at = to


def _profiles(dims: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for rows, texts in _batches(batches):
            langs = rows.column(rows.schema.get_field_index("lang")).to_pylist()
            b = bundled(texts, dims)
            if not b.counts.size:
                continue
            weights = b.counts / np.maximum(1, np.sqrt((b.counts**2).sum(axis=1, keepdims=True)))
            names = sorted(set(langs))
            picks = np.array([[x == name for x in langs] for name in names], np.float32)
            for name, vector in zip(names, (picks @ weights) @ _trigram_vectors(*b.parts, dims), strict=True):
                sums[name] = sums.get(name, 0) + vector.astype(np.float64)
        for name, vector in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [name] * dims, "dim": np.arange(dims), "value": vector})

    return run


@dataclass
class Profiles:
    """Unit prototypes of the languages, one row each."""

    langs: list[str]
    vectors: np.ndarray

    @property
    def dims(self) -> int:
        return self.vectors.shape[1]


def learn_profiles(labelled: DataFrame, dims: int = DIMENSIONS) -> Profiles:
    """Bundle all rows of ``labelled (text, lang)`` to a prototype of each language.

    Every text weighs the same. Rows without lang are left out, null and empty
    texts add nothing. One vector for each language comes to the driver, so ``lang``
    must name languages, not rows: over ``MOST_LANGUAGES`` names are refused.
    """
    names = labelled.where("lang is not null").select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if names > MOST_LANGUAGES:
        raise ValueError(f"lang has over {MOST_LANGUAGES} names")
    rows = labelled.where("lang is not null").select("text", "lang").mapInArrow(_profiles(dims), "lang string, dim long, value double")
    table = rows.groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    found: dict[str, np.ndarray] = {}
    for lang, dim, value in table.collect():
        found.setdefault(lang, np.zeros(dims))[dim] = round(value, 6)
    langs = sorted(x for x, v in found.items() if v.any())
    vectors = np.array([found[x] / np.linalg.norm(found[x]) for x in langs], np.float32).reshape(len(langs), dims)
    return Profiles(langs, vectors)


@dataclass
class Seen:
    """For each language, sorted codes of the trigrams that its labelled texts hold, with the number of texts that hold each, and how many texts it takes."""

    tables: dict[str, tuple[np.ndarray, np.ndarray]]
    least: dict[str, int]
    single: frozenset[str]  # languages of one labelled text, which no other text can bear out


def _trigram_codes(b: Bundles) -> np.ndarray:
    first, second, third, alphabet = b.parts
    return (alphabet[first] << 42) | (alphabet[second] << 21) | alphabet[third]


def _trigram_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for rows, texts in _batches(batches):
        langs = np.array(rows.column(rows.schema.get_field_index("lang")).to_pylist(), object)
        b = bundled(texts, 1)
        if not b.counts.size:
            continue
        own = _trigram_codes(b)
        for name in set(langs):
            held = (b.counts[langs == name] > 0).sum(axis=0)
            codes, counts = found.get(name, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            codes, place = np.unique(np.concatenate((codes, own[held > 0])), return_inverse=True)
            found[name] = codes, np.bincount(place, np.concatenate((counts, held[held > 0])), len(codes)).astype(np.int64)
    for name, (codes, counts) in found.items():
        yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(codes), pa.string()), "code": codes, "texts": counts})


def seen_trigrams(labelled: DataFrame) -> Seen:
    """The trigrams that, of a language's texts in ``labelled (text, lang)``, one in ten thousand holds, or one text where there are fewer.

    At most ten thousand times the distinct trigrams of a mean text come to the driver for each language.
    """
    rows = labelled.where("lang is not null").select("text", "lang")
    counts = rows.groupBy("lang").agg(F.greatest(F.lit(1), F.floor(F.count("*") / 10_000)).alias("least"), F.count("*").alias("n"))
    sizes = counts.collect()
    table = rows.mapInArrow(_trigram_texts, "lang string, code long, texts long").groupBy("lang", "code").agg(F.sum("texts").alias("texts"))
    kept = table.join(F.broadcast(counts), "lang").where("texts >= least").select("lang", "code", "texts").toArrow()
    langs = kept.column("lang").to_numpy()
    codes, texts = (kept.column(n).to_numpy() for n in ("code", "texts"))
    tables = {}
    for name in {r.lang for r in sizes}:
        own = np.flatnonzero(langs == name)
        own = own[np.argsort(codes[own])]
        tables[name] = codes[own], texts[own]
    return Seen(tables, {r.lang: r.least for r in sizes}, frozenset(r.lang for r in sizes if r.n == 1))


def _share(seen: Seen, b: Bundles, named: list[str | None], langs: list[str | None]) -> np.ndarray:
    """Of each bundled document's trigrams, the share that labelled texts of the language it is named as hold."""
    share, codes = np.zeros(len(named)), _trigram_codes(b)
    if not b.counts.size:
        return share
    named, langs = np.array(named, object), np.array(langs, object)
    for name in {x for x in named if x in seen.tables}:
        rows, (known, texts) = np.flatnonzero(named == name), seen.tables[name]
        if not len(known):
            continue
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        held = np.where(known[at] == codes, texts[at], 0)
        own = (langs[rows] == name) & (name not in seen.single)  # a text does not count for itself
        alone, others = (b.counts[rows] @ (held >= seen.least[name] + k).astype(np.float32) for k in (0, 1))
        share[rows] = np.where(own, others, alone) / np.maximum(1, b.counts[rows].sum(axis=1))
    return share


def _kept(profiles: Profiles, seen: Seen, least: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _batches(batches):
            b = bundled(texts, profiles.dims)
            named, _ = _nearest(profiles, b)
            share = _share(seen, b, named, rows.column(rows.schema.get_field_index("lang")).to_pylist())
            yield rows.filter(pa.array((share >= least) & np.array([x is not None for x in named], bool)))

    return run


def kept_rows(docs: DataFrame, profiles: Profiles, seen: Seen, least: float) -> DataFrame:
    """The rows of ``docs (text, lang, ...)`` that the language which ``identify`` gives them bears out, with all their columns.

    Of a row's letter trigrams, labelled texts of that very language must hold a share of ``least`` or more; what
    other languages' texts hold does not count. A text of that label does not count for itself, unless it
    is the only one of its language. A text without letters is in no language and goes, as does any text if none is labelled.
    """
    return docs.mapInArrow(_kept(profiles, seen, least), docs.schema)


def _nearest(profiles: Profiles, b: Bundles) -> tuple[list[str | None], np.ndarray]:
    """The language whose prototype is nearest to each bundled document, None without letters or prototypes, and the cosine (0 to 1)."""
    n = len(b.letters)
    score, best = np.zeros(n), np.zeros(n, np.int64)
    if profiles.langs and b.counts.size:
        documents = b.counts @ _trigram_vectors(*b.parts, profiles.dims)
        norms = np.maximum(1e-9, np.linalg.norm(documents, axis=1, keepdims=True))
        cosine = documents / norms @ profiles.vectors.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine.max(axis=1), 0, 1).astype(np.float64)
    known = (b.letters > 0) & bool(profiles.langs)
    return [profiles.langs[i] if k else None for i, k in zip(best, known, strict=True)], np.where(known, score, 0.0)


def _predicted(profiles: Profiles):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _batches(batches):
            langs, score = _nearest(profiles, bundled(texts, profiles.dims))
            kept = {f.name: rows.column(i) for i, f in enumerate(rows.schema) if f.name != "text"}
            yield pa.RecordBatch.from_pydict(kept | {"lang_pred": pa.array(["und" if x is None else x for x in langs], pa.string()), "score": pa.array(score)})

    return run


def identify(docs: DataFrame, profiles: Profiles, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``lang_pred`` and ``score`` (cosine with that language's prototype, 0 to 1) of each row's whole ``text``.

    The columns in ``keep`` (not ``text``) are carried along. A null text or one
    without letters is ``und`` with score 0, as is any text if there are no
    prototypes. Equal cosines go to the first language in code-point order.
    """
    rows = docs.select(*keep, "text")
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "text") + ", lang_pred string, score double"
    return rows.mapInArrow(_predicted(profiles), schema)
