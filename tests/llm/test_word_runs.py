"""Words with runs of marks behind them are merged by the model, once a word; all ids are the library's."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from polyview.llm import tokens

BOTH = pytest.mark.parametrize(("name", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])


@BOTH
def test_words_with_runs_of_marks_are_merged_once(name, keeps):
    path = public_tokenizers.path(name)
    tool, whole = tokens.Encoder(path, keeps, "<u4"), Tokenizer.from_file(path)
    asked, model = [], tool.tokenizer.model

    class Model:
        def tokenize(self, word):
            asked.append(word)
            return model.tokenize(word)

    class Tool:
        model = Model()

        def encode(self, *_, **__):
            raise AssertionError("the library's whole chain")

    tool.tokenizer = Tool()
    words, marks = ["athawh", "thonre", "élevire", "MENTOUX"], ["$$$", "!!", ".%%%", "***", "", "###", "_|<>"]
    texts = ["x " + " ".join(w + m for m in marks for w in words), "x " + " ".join(w + m + m for m in marks for w in words)]
    for t, got in zip(texts, tool.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids
    assert len(asked) == len(set(asked)) == 1 + len(words) + 2 * (len(marks) - 1)


@BOTH
@pytest.mark.parametrize("limit", [400_000, 20])
def test_ids_of_any_pieces(name, keeps, limit):
    """Also where pieces are forgotten and met again, and where plain and odd pieces share a text."""
    path, draw = public_tokenizers.path(name), random.Random(7)
    tool, whole = tokens.Encoder(path, keeps, "<u4", limit=limit), Tokenizer.from_file(path)
    parts = ["the", "Thing", "É", "ß", "ñandú", "ÿ", "µ", "ª", "×", "İ", "ſ", "K", "日本", "мир", "é", "7", "42", "²", "'", "'s", "'LL", "n't", "...", "_", "--", "$$$", "!?", "<|", "|>", "/", "«", "…", "👍", "‍", "\n"]
    texts = ["", None, " ", "\n", "a", "it's", "'s", "l'ami's!!", "x'", "a\n\nb", "a \nb", "  a", "<|endoftext|>!", *("".join(draw.choice([*parts, " ", " "]) for _ in range(draw.randint(1, 30))) for _ in range(1500))]
    for at in range(0, len(texts), 100):
        step = texts[at : at + 100]
        for t, got in zip(step, tool.encode(step), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == whole.encode(t or "", add_special_tokens=False).ids, t
