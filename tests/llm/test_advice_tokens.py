"""Texts that hold the content of an added token."""

import brute
import numpy as np
from conftest import SCHEMA

from verimet.llm import tokens
from verimet.session import work_path

END = "<|endoftext|>"
TEXTS = [f"end of page {END} next", END, f"{END}{END}", f"a{END}b", f"  {END}\n\n", f"日本 {END} ok", "<|endoftext| >", "<|endof text|>", "end of page next"]


def _tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_added_tokens_in_texts():
    """The library's plain encoding, whatever was remembered before."""
    path, tokenizer = _tokenizer()
    work = tokens.Encoder(path)
    for texts in (TEXTS, TEXTS[::-1], TEXTS):
        for text, data in zip(texts, work(texts), strict=True):
            assert np.frombuffer(data, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(work(TEXTS[:1])[0], "<u4").tolist() == [437, 286, 2443, 220, 50256, 1306]


def test_added_tokens_in_files(spark):
    """Counts, checksums and the places of all later documents."""
    path, tokenizer = _tokenizer()
    rows = [(k, text, "en", "a", len(text)) for k, text in enumerate(TEXTS)]
    folder = work_path(spark, "added-tokens")
    tokens.write_tokens(spark.createDataFrame(rows, SCHEMA).repartition(3), folder, path)
    assert sorted(tuple(r) for r in tokens.token_summary(spark, folder).collect()) == brute.token_rows([r[:2] for r in rows], tokenizer)
