"""Odd rows, clashing columns and rarely used paths of the corpus operators and the pipeline."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from polyview.llm import common, decontaminate, idstore, language, licenses, packing, pseudonyms, repetition, toxicity
from polyview.llm.queries import tokenizer


def test_overlaps_by_shuffle_equal_those_by_broadcast(spark, monkeypatch):
    words = [f"v{k % 37}x{k % 11}" for k in range(400)]
    items = [(k, " ".join(words[7 * k : 7 * k + n])) for k, n in enumerate((6, 9, 13, 14, 30, 30))]
    docs = [(1, " ".join(words[5:60])), (1, " ".join(words[5:60])), (1, "other text"), (2, None), (3, ""), (None, " ".join(words[20:50])), (4, "x " * 30_000 + " ".join(words[:40]))]
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: sorted(map(repr, decontaminate.overlaps(table, bench).collect()))
    want = rows()
    assert len(want) > 5
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 3)
    assert rows() == want
    kept = {r["doc_id"] for r in decontaminate.clean(table, bench).collect()}
    monkeypatch.setattr(common, "MOST_IDS", 0)
    assert {r["doc_id"] for r in decontaminate.clean(table, bench).collect()} == kept == {2, 3, None}


KEY = pseudonyms.Pseudonyms(b"k")


def test_dates_stay_linked_across_forms():
    for y, m, d in ((2020, 12, 25), (1999, 2, 13), (2001, 3, 4), (1900, 1, 31)):
        forms = [f"{y}-{m:02}-{d:02}", f"{y}/{m:02}/{d:02}", f"{d:02}.{m:02}.{y}", f"{d:02}/{m:02}/{y}"] + ([f"{m:02}/{d:02}/{y}"] if d > 12 else [])
        new = [KEY.rewrite(f)[0] for f in forms]
        days = {(a[:4], a[5:7], a[8:]) if k < 2 else (a[6:], a[3:5], a[:2]) if k < 4 else (a[6:], a[:2], a[3:5]) for k, a in enumerate(new)}
        assert len(days) == 1 and [KEY.rewrite(n, back=True)[0] for n in new] == forms
    late = pseudonyms._days(True)
    assert len({KEY._date(str(pseudonyms.datetime.date.fromordinal(x)), False) for x in late[:3000]}) == 3000


@pytest.mark.parametrize("width", [40, 60, 66, 72, 74, 80, 90])
def test_wrapped_licences_are_found(spark, width):
    import textwrap

    full = {name: texts[-1] for name, texts in licenses.KNOWN.items() if "\n\n" in texts[-1]}
    rows = [(name, "\n\n".join(textwrap.fill(b, width) for b in t.split("\n\n"))) for name, t in full.items()]
    docs = spark.createDataFrame([*rows, ("two", "licence licence"), ("none", "copyright holders may")], "doc_id string, text string")
    got = {r["doc_id"]: (r["license_ids"], r["whole"]) for r in licenses.scan(docs).collect()}
    assert {k: v for k, v in got.items() if k in full} == {name: (name, True) for name in full}
    one = licenses.scan(spark.createDataFrame([(1, "the licence licence whilst whilst")], "doc_id long, text string"), {"X": ("the license license while while",)}).first()
    assert one["license_ids"] == "X" and one["whole"]


def test_long_licences_are_known_by_their_digests(spark):
    folder = "/usr/share/common-licenses"
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "MPL-2.0": "MPL-2.0"}
    there = {k: f"{folder}/{f}" for k, f in files.items() if os.path.exists(f"{folder}/{f}")}
    if not there:
        pytest.skip("no licence texts on this machine")
    docs = spark.createDataFrame([(k, "Title of this software\n\n" + open(f).read() + "\n\nmore words") for k, f in there.items()], "doc_id string, text string")
    assert all(r["doc_id"] in r["license_ids"].split(",") for r in licenses.scan(docs).collect())


def test_shares_are_of_characters():
    clean, passage = " ".join(f"w{k}" for k in range(60)), "éééééééééé ab cd ef gh ij"
    text = f"{clean} {passage} {passage}"
    got = dict(zip([c.split()[0] for c in repetition.COLUMNS.split(", ")], repetition.measure(text), strict=True))
    assert got["share_6"] == pytest.approx(20 / len(re.sub(r"\s", "", text)))
    lines = "é\né\nabc"
    got = dict(zip([c.split()[0] for c in repetition.COLUMNS.split(", ")], repetition.measure(lines), strict=True))
    assert got["line_share"] == pytest.approx(1 / len(lines))


def test_results_replace_columns_of_their_names(spark):
    docs = spark.createDataFrame([(1, "der die das " * 20, "aa", "x", 5, 1.0, "q")], "doc_id long, text string, lang string, kept string, n_words int, score double, lang_pred string")
    out = repetition.repetition(docs)
    assert len(out.columns) == len(set(out.columns)) and out.first()["n_words"] == 60
    out = language.identify(docs, language.train(docs))
    assert len(out.columns) == len(set(out.columns)) and out.first()["lang_pred"] == "aa"
    out = toxicity.score(docs, toxicity.fit([], np.empty(0)))
    assert len(out.columns) == len(set(out.columns)) and out.first()["score"] < 1e-12


def test_numerals_are_no_letters_and_bins_are_followed(spark):
    assert len(language.grams("²½ ¹")) == 0 and list(language.grams("x²")) == list(language.grams("x"))
    docs = spark.createDataFrame([(k % 3, t, lang) for k, (t, lang) in enumerate([("the house and", "en"), ("das haus und", "de")] * 30)], "doc_id long, text string, lang string")
    model = language.train(docs, per_lang=10, bins=1 << 10)
    assert model.weights.shape == (1 << 10, 2)
    got = language.identify(spark.createDataFrame([(1, "das haus"), (2, "½²")], "doc_id long, text string"), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {1: "de", 2: "und"}


def test_stores_and_packings_of_odd_rows(spark):
    rows = [(None, "a b"), (None, None), (3, "same"), (3, "same"), (3, "other"), (1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = common.new_path(spark, "test-store")
    idstore.write_store(docs, path, tokenizer("byte_bpe_50k.json"), end_id=0)
    got = idstore.read_digests(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 3, 3, 3]
    ends = np.cumsum([r["n_tokens"] for r in got]).tolist()
    assert [r["start"] for r in got] == [0, *ends[:-1]]
    packed = packing.pack_texts(docs, tokenizer("word_bpe_49k.json")).collect()
    assert len(packed) == 6 and len({r["sequence_id"] for r in packed}) == 1 and sorted(r["offset"] for r in packed)[0] == 0


def test_altered_and_missing_chunks_are_errors(spark):
    docs = spark.createDataFrame([(k, f"text number {k} " * 100) for k in range(6)], "doc_id long, text string")
    path = common.new_path(spark, "test-store")
    idstore.write_store(docs, path, tokenizer("byte_bpe_50k.json"), end_id=0)
    whole = spark.read.schema(idstore._SCHEMA.format(id="bigint")).parquet(path)
    chunk = F.col("kind") == "chunk"
    for changed, message in ((whole.withColumn("ids", F.when(chunk, F.concat("ids", F.lit(b"\0\0"))).otherwise(F.col("ids"))), "altered"), (whole.where(~chunk), "missing")):
        other = common.new_path(spark, "test-store")
        changed.write.partitionBy("kind", "bucket").parquet(other)
        with pytest.raises(Exception, match=message):
            idstore.read_digests(spark, other).collect()


def test_stages_on_odd_tables(spark):
    sf = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", None, None, None), (3, "a few words here only", "en", "s", 5), (3, "a few words here only", "en", "s", 5), (None, "no id at all but words", "en", "s", 9)], schema).withColumn("extra", F.lit(1)).withColumn("node", F.lit("clash"))
    for own, n in ((docs, 5), (docs.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES[:4]:
            after = stage(spark, own, sf)
            assert tuple(after.columns) == corpus_pipeline.COLUMNS and after.count() == n
        assert corpus_pipeline.STAGES[4][1](spark, own, sf).count() == n


def test_toxic_documents_leave_the_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, docs, sf).select("doc_id").collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert np.mean([k in kept for k, y in truth.items() if not y]) > 0.99
    assert np.mean([k not in kept for k, y in truth.items() if y]) > 0.7
