"""A word is merged once, with whatever mark it comes."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from polyview.llm import tokens


@pytest.mark.parametrize(("name", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_a_word_is_merged_once(name, keeps):
    path = public_tokenizers.path(name)
    tool = tokens.Encoder(path, keeps, "<u4")
    asked, model = [], tool.tokenizer.model

    class Model:
        def tokenize(self, word):
            asked.append(word)
            return model.tokenize(word)

    class Tool:
        def __init__(self, own):
            self.model, self.encode = Model(), own.encode

    tool.tokenizer = Tool(tool.tokenizer)
    words = ["athawh", "thonre", "élevire", "Mentoux"]
    texts = [" ".join(["x", *(w + m for w in words for m in ("", ",", ".", "!", "?"))]), " ".join(["x", *(w + m for w in words for m in (";", ":"))])]
    whole = Tokenizer.from_file(path)
    for t, got in zip(texts, [tool.encode([t])[0] for t in texts], strict=True):
        assert np.frombuffer(got, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids
    assert len(asked) == len(set(asked)) == len(words) + 1
