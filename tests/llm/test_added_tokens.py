"""The ids of op8 on texts that hold the added token of the tokenizer."""

from __future__ import annotations

import numpy as np
import public_tokenizers

from ledgerline.llm.packing import token_ids

TEXTS = [
    "one <|endoftext|> two",
    "<|endoftext|>",
    "a  <|endoftext|><|endoftext|>\n\n b",
    "<|endoftext|",
    "<|<|endoftext|>|> x<|endoftext|>y <|ENDOFTEXT|>",
    "no such token é   　",
]


def test_added_tokens_in_texts(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    given = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    made = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_ids(given).collect()}
    for i, text in enumerate(TEXTS):
        assert made[i] == tokenizer.encode(text, add_special_tokens=False).ids + [0]
    assert 50256 in made[0] and 50256 not in made[3]
