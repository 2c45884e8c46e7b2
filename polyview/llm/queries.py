"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyview.llm import decontaminate, idstore, jaccard, language, licenses, packing, pitman_yor, pseudonyms, repetition, toxicity
from polyview.llm.common import fold, new_path

PII_KEY = b"polyview-demonstration-key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pitman_yor.score(docs, fold("doc_id", 7) != 2).withColumn("held_out", fold("doc_id", 7) == 2)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file, the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), n=3, percent=90)


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "store")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    idstore.write_store(docs, path, tokenizer("byte_bpe_50k.json"), end_id=0)
    return idstore.read_digests(spark, path, docs.schema["doc_id"].dataType.simpleString())


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op8_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold("_id", 5) != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs, fold("_id", 5) != 0)
    return language.identify(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_pitman_yor, op2_decontamination, op3_best_fit_packing, op4_license_scan, op5_ngram_jaccard, op6_token_store, op7_pii_pseudonyms, op8_repetition, op9_toxicity, op10_language)}


def _license_sql() -> str:
    known = ", ".join(f"('{d}', '{n}')" for d, n in licenses.known_digests(licenses.KNOWN, licenses.LONG))
    fixed = "replace(regexp_replace(o, '\\n', ' \n ', 'g'), ' ', '  ')"
    for a, b in licenses.SPELLINGS:
        fixed = "replace({}, '{}', '{}')".format(fixed, *(f" {x} ".replace(" ", "  ")[1:-1] for x in (a, b)))
    whole, block = "regexp_replace(' ' || c || ' ', '[ \\n]+', ' ', 'g')", "regexp_replace(' ' || unnest(regexp_split_to_array(c, '\\n ?\\n')) || ' ', '[ \\n]+', ' ', 'g')"
    for a, b in [x for x in licenses.SPELLINGS if " " in x[0]] * 2:
        whole, block = (f"replace({x}, ' {a} ', ' {b} ')" for x in (whole, block))
    return f"""
WITH known(digest, license) AS (VALUES {known}),
low AS (SELECT doc_id, regexp_replace(regexp_replace(lower(' ' || text || ' '), '{licenses._COPYRIGHT}', '', 'g'), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') AS o FROM documents),
canon AS (SELECT doc_id, replace(regexp_replace({fixed}, ' *\\n *', '\n', 'g'), '  ', ' ') AS c FROM low),
units AS (
  SELECT doc_id, sha256(trim({whole})) AS w, NULL AS u, true AS whole FROM canon
  UNION ALL SELECT doc_id, NULL, sha256(trim({block})), false FROM canon
  UNION ALL SELECT doc_id, NULL, sha256(trim(unnest(string_split(c, '\n')))), false FROM canon),
hits AS (SELECT doc_id, coalesce(w, u) AS digest, license, whole FROM units JOIN known ON coalesce(w, u) = digest),
per AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS l, count(DISTINCT digest) AS n, max(whole) AS w FROM hits GROUP BY doc_id)
SELECT d.doc_id, coalesce(l, '') AS license_ids, coalesce(n, 0) AS n_units, coalesce(w, false) AS whole
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN per ON d.doc_id = per.doc_id"""


#: Items here have 13 words at least. A window that fits has an equal word among its first three, so windows are tried there.
_LEAK_SQL = """
WITH d AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS p, unnest(w) AS x, len(w) AS m FROM (
       SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents)),
b AS (SELECT item_id, generate_subscripts(w, 1) - 1 AS q, unnest(w) AS x, len(w) AS n FROM (
       SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) >= 13),
same AS (SELECT doc_id, item_id, p - q AS diag, q, m, n FROM d JOIN b USING (x)),
dense AS (SELECT * FROM same QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, diag) >= 11),
tried AS (SELECT DISTINCT doc_id, item_id, diag, q - k AS a FROM dense, range(3) AS r(k)
          WHERE q - k >= 0 AND q - k + 13 <= n AND q - k + diag >= 0 AND q - k + diag + 13 <= m),
fits AS (SELECT t.doc_id, t.item_id, t.diag, t.a, count(*) AS same FROM tried t JOIN dense s
         ON t.doc_id = s.doc_id AND t.item_id = s.item_id AND t.diag = s.diag AND s.q BETWEEN t.a AND t.a + 12 GROUP BY ALL HAVING count(*) >= 11)
SELECT doc_id, item_id, min(a + diag)::BIGINT AS first_word, max(a + diag + 12)::BIGINT AS last_word, max(same)::BIGINT AS best FROM fits GROUP BY doc_id, item_id"""

ORACLES = {"op2_decontamination": _LEAK_SQL, "op4_license_scan": _license_sql()}
