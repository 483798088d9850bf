"""Ids of odd runs are those of the library's plain call."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortloom.llm.packing import Encoder

FILE = public_tokenizers.path("word_bpe_49k.json")
RUNS = ["İ.", "ß!", "Ⅷ.", "ÉÉ!?", "क़.", "é.", "a_b", "x<|EndOfText|>y.", "<|startoftext|>!", "<|", "A.b.C!", "ABC...", "1.5!", "ﬁ.", "Ω;", "don't."]


@pytest.mark.parametrize("special", [False, True])
def test_ids_of_odd_runs(special):
    library = Tokenizer.from_file(FILE)
    library.encode_special_tokens = not special
    texts = [*RUNS, " ".join(RUNS), "".join(RUNS), "\n".join(reversed(RUNS))]
    got = Encoder(FILE, special).encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, text
