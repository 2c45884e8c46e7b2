"""Licences, pseudonyms, repetition: against brute force and on edge cases."""

import collections
import datetime
import re

import pytest

from polyview.llm import licenses, pseudonyms, repetition

EDGE = [None, "", " ", "\n\n", "word", "é" * 50_000, "a b c " * 4000, "the same line\nthe same line\nthe same line"]


def table(spark, texts, extra=()):
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)] + list(extra)
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, score int")


def brute_repeats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    return len({k + j for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for j in range(3)})


@pytest.mark.parametrize("text", [*EDGE, "a b c d a b c e f a b", "x x x x", "#*$ a|b <c> 100%\n#*$ a|b <c> 100%"])
def test_base_counts(text):
    got = dict(zip([c.split()[0] for c in repetition.COLUMNS.split(", ")], repetition.measure(text), strict=True))
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    assert got["n_words"] == len(words) and got["word_chars"] == sum(map(len, words))
    assert got["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text or ""))
    assert got["n_dup_lines"] == len(lines) - len(set(lines)) and got["n_repeat_words"] == brute_repeats(text)


def test_repeated_text_is_dropped_and_clean_text_kept():
    clean = " ".join(f"w{k}" for k in range(200))
    assert repetition.measure(clean)[-1] is True
    passage = " ".join(f"p{k}" for k in range(60))
    assert repetition.measure(f"{clean} {passage} {passage} {passage}")[-1] is False


def test_repetition_table(spark):
    out = repetition.repetition(table(spark, EDGE).select("doc_id", "text"))
    assert out.count() == len(EDGE)
    assert repetition.repetition(table(spark, [])).count() == 0


KEY = pseudonyms.Pseudonyms(b"k")


@pytest.mark.parametrize("value", ["4111 1111 1111 1111".replace("1111 1111", "1111 1111"), "5500-0000-0000-0004", "+1 (743) 555-3824", "219-09-9999", "172.16.254.1", "2024-02-29", "31.12.1999", "12/31/1999", "01/02/2003", "a.b9@mail5.example.com"])
def test_formats_are_kept_and_restored(value):
    text = f"before {value}, after"
    new, counts = KEY.rewrite(text)
    assert sum(counts.values()) == 1 and new != text and len(new) == len(text)
    assert re.sub(r"[a-z]", "a", re.sub(r"\d", "0", new)) == re.sub(r"[a-z]", "a", re.sub(r"\d", "0", text)) or "." in value
    assert KEY.rewrite(new, back=True)[0] == text
    assert KEY.rewrite(new)[1] == counts  # still valid in its format


@pytest.mark.parametrize("text", ["4111 1111 1111 1112", "2023-02-30", "999.1.1.1", "000-12-3456", "version 1.2.3", "x" * 100_000, "", "pages 10-20"])
def test_invalid_values_stay(text):
    assert KEY.rewrite(text) == (text, dict.fromkeys(pseudonyms.KINDS, 0))


def test_equal_values_stay_linked_and_the_map_is_a_bijection():
    a, b = KEY.rewrite("4111 1111 1111 1111")[0], KEY.rewrite("4111-1111-1111-1111")[0]
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b)
    assert sorted(KEY.permuted("t", 500, k) for k in range(500)) == list(range(500))
    day = datetime.date(1999, 12, 31)
    assert KEY.rewrite(f"{day}")[0] == KEY.rewrite(f"{day}")[0] != pseudonyms.Pseudonyms(b"other").rewrite(f"{day}")[0]


def test_pseudonym_table(spark):
    docs = table(spark, [None, "", "call +1 (743) 555-3824"], [(None, "2024-02-29", None, None), (2, "call +1 (743) 555-3824", None, None)])
    out = {(r["doc_id"], r["text"]): r for r in pseudonyms.pseudonymise(docs, b"k").collect()}
    assert len(out) == 4 and (0, None) in out and (1, "") in out
    assert "kept" in pseudonyms.pseudonymise(docs, b"k").columns


def test_licenses(spark):
    mit = licenses.KNOWN["MIT"][-1]
    docs = table(spark, [None, "", "some words", f"Copyright (c) 2020 Someone\n\n{mit.upper()}", "text\nReleased under the MIT LICENCE!\nmore", f"intro\n\n{licenses.KNOWN['MIT'][1]}\n\nLicensed under CC BY 4.0."], [(4, "Licensed under the Apache License, Version 2.0.", "x", 1), (None, "SPDX-License-Identifier: ISC", None, None)])
    got = {r["doc_id"]: (r["license_ids"], r["n_units"], r["whole"]) for r in licenses.scan(docs).collect()}
    assert got[0] == got[1] == got[2] == ("", 0, False)
    assert got[3][0] == "MIT" and got[3][2]
    assert got[4] == ("Apache-2.0,MIT", 2, True)
    assert got[5][0] == "CC-BY-4.0,MIT" and not got[5][2]
    assert got[None][0] == "ISC"
    assert licenses.scan(table(spark, [])).count() == 0
    assert {r["license_ids"] for r in licenses.scan(docs, {}).collect()} == {""}
