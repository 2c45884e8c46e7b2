"""A corpus pipeline over ``documents``: toxicity, near duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again for the next. The first four
return the columns of documents, whatever other columns there are; the last returns the packed pieces. Each stage works on
empty tables too. The stages set the session's Arrow batches to BATCH rows at most, as texts are long and a batch is held on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from polyview.llm import decontaminate, jaccard, packing, pseudonyms, toxicity
from polyview.llm.common import fold, stored, without
from polyview.llm.queries import PII_KEY, table, tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


BATCH = 2000


def _small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores 0.5 or more go. It learns from the labelled rows of docs as op 9 does, and
    without any, all stay. Null and empty texts are scored as texts without terms; repeated rows stay or go together."""
    _small_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold("_id", 5) != 0)
    return toxicity.score(docs, model, out="_score").where("_score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of five-word shingles with a similarity of 0.8 or more, the document with the smallest id stays; documents
    without words are in no class and stay, as do those without an id. Repeated rows of an id count as one document."""
    _small_batches(spark)
    found = jaccard.classes(docs, n=5, percent=80).where("doc_id <> component_id").select("doc_id")
    return without(docs, found).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap an item of the benchmark go, with all rows of their ids; null and empty texts and rows without an id
    stay."""
    _small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Valid numbers, dates and addresses become pseudonyms of the same format, so lengths don't change. Every row stays; nulls stay
    null and empty texts empty."""
    _small_batches(spark)
    return pseudonyms.pseudonymise(docs, PII_KEY).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's token ids in sequences of at most 4096 tokens; null and empty texts are the end token alone, and repeated rows are
    packed each for itself."""
    _small_batches(spark)
    return packing.pack_texts(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", hide_personal_data),
    ("packing", pack),
]

#: Learned scores, keyed permutations and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each but the last returns is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
