"""Texts cut and encoded together have the ids that the library gives each whole text."""

import sys

import numpy as np
import pyarrow as pa

from caselog.llm import token_output
from caselog.llm.queries import tokenizer_file

END = np.array([2], dtype="<u4").tobytes()
BLANKS = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()]


def test_ids_are_those_of_whole_texts():
    texts = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n\nb c", "the same the same", "x<|endoftext|>y z", "a <|endoftext|> b", "é ü   ö", "don't we'll 12 345"]
    texts += [t for b in BLANKS for t in (f"one{b} two three", f"one {b}two", f"one{b}{b}two three", b)]
    encode = token_output.Encoder(tokenizer_file("byte_bpe_50k.json"))
    cache = token_output.Cache(encode)
    got = token_output._ids(cache, pa.array(texts * 2), END)
    for text, ids in zip(texts * 2, got):
        assert ids.tolist() == [*encode.tokenizer.encode(text, add_special_tokens=False).ids, 2], text


def test_a_text_is_not_walked_chunk_by_chunk(monkeypatch):
    """Python sees each different chunk of a slice once, however often it comes."""
    seen = []
    cache = token_output.Cache(token_output.Encoder(tokenizer_file("byte_bpe_50k.json")))
    values = cache.values
    monkeypatch.setattr(cache, "values", lambda keys: seen.append(len(keys)) or values(keys))
    token_output._ids(cache, pa.array(["one two three " * 1000] * 5), END)
    assert sum(seen) < 20
