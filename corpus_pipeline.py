"""From raw documents to token files: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import decontaminate, language, mixing, near_dedup, storage, token_store
from basketry.llm.queries import END_ID, WEIGHTS, tokenizer_path

#: Below this share of trigrams that labelled texts of its language hold, a text is not in that language.
#: Cosines do not tell: those of foreign texts are noise of deviation 1/32, and short clean texts come as low.
LEAST_SEEN = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents of no learned language: those that operator 1 gives none, and those that the language it gives does not bear out.

    Each text goes to the nearest of the languages' prototypes, as in ``op1_language_id``; of its letter trigrams, labelled texts
    of that language must then hold half (exact counts). What texts of other languages hold does not count.

    A null or empty text has no letters and goes. A label is optional; a text never
    vouches for itself, however long it is. Rows are judged one by one, so repeated
    rows, null ids and ties need no rule, and all columns are kept as they are. An
    empty table, or one without labels, gives an empty result.
    """
    return language.kept_rows(docs, language.learn_profiles(docs), language.seen_trigrams(docs), LEAST_SEEN)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the least doc_id, of each group of near duplicates (five-word shingles, 0.8).

    Of repeated rows of that doc_id the first stays; rows without doc_id come after
    all others. Null and empty texts stand alone and stay. All columns are kept; an
    empty table gives an empty result.
    """
    return near_dedup.one_of_each(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that benchmark passages contaminate: hit words are a twentieth of all or more.

    Every row is judged by its own whole text, also where doc_ids repeat or are
    null. Null and empty texts have no words and stay, as do all if the benchmark
    is empty. All columns are kept; an empty table gives an empty result.
    """
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes it; those it does not take go.

    Null and empty texts have no words and are never taken. A null source is a source
    too. Rows without doc_id take part, ordered by their text; repeated rows, equal
    in the seeded order, are taken together or not at all. All columns are kept,
    whatever their names; an empty table gives an empty result.
    """
    return mixing.repeated(docs, F.array("source"), WEIGHTS, share=1.5, cap=2.0)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token shards in doc_id order and return what they hold for each document.

    Null and empty texts hold the end id alone; repeated rows come one after the
    other, rows without doc_id first. An empty table gives no shard and no row.
    """
    return token_store.tokenized(docs, tokenizer_path(), END_ID)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_output", token_output),
]

#: Trigram shares, seeded order and token ids have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = storage.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
