"""Added tokens within texts, against tokenizers at its default setting."""

import numpy as np
from tokenizers import Tokenizer

from marginalia.llm import packing
from marginalia.llm.queries import tokenizer_file


def test_added_tokens_are_single_ids():
    encoder = packing.PieceEncoder(tokenizer_file(), added_tokens=True)
    t = Tokenizer.from_file(tokenizer_file())
    for text in ["a<|endoftext|>b", "<|endoftext|>", " one <|endoftext|> two  <|endoftext|><|endoftext|>\n three", "plain <|endoftext text", ""]:
        assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == t.encode(text, add_special_tokens=False).ids
