import unicodedata

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brindle.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
CASES = ["", "  ", "Hello, world's END", "naïve ÉCOLE ΣΑΣ", "x" * 5000, "a1b22 c3\x1cd\x85e f", "<|startoftext|>hi<|endoftext|>", "😀 ½ don't I'LL", "a" * 70 + "." * 90, "ǅ İ ß"]


@pytest.mark.parametrize("text", CASES)
def test_matches_the_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    v = bpe.vocabulary(PATH)
    assert v.encode(text) == want
    assert v.decode(want) == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=80))
def test_any_text(text):
    assert bpe.vocabulary(PATH).encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_every_assigned_character():
    v = bpe.vocabulary(PATH)
    shown = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cs", "Cn", "Co")]
    text = " ".join("a" + c + "b " + c for c in shown)
    for at in range(0, len(text), 200_000):
        part = text[at : at + 200_000]
        assert v.encode(part) == LIBRARY.encode(part, add_special_tokens=False).ids


def test_rows_and_nulls(spark):
    df = spark.createDataFrame([(1, "One two"), (2, None), (3, ""), (1, "One two")], "doc_id int, text string")
    got = df.select("doc_id", bpe.encode(F.col("text"), PATH).alias("ids")).collect()
    want = LIBRARY.encode("One two", add_special_tokens=False).ids
    assert [r.ids for r in got] == [want, [], [], want]


def test_tree_yields_the_leftmost_lowest():
    tree = bpe.PairTree([5, 3, 3, 9])
    assert tree.root() == (3, 1)
    tree.update(1, 7)
    assert tree.root() == (3, 2)
    assert np.array(tree.nodes).dtype.kind in "iu"
