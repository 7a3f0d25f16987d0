"""Ids put together from parts against the library on whole texts."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from aislefix.llm.cells import text_slices
from aislefix.llm.encoding import Encoder

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
MADE = {name: (Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))) for name in FILES}

EDGES = [None, "", " ", "\n", "a", " a", "a ", "a  b", "a \n b", "one\ntwo\n\nthree\n", "The THE the, (x) it's we'LL 'tis don't.", "é é Éa J̌ İ ß ÿ À×÷",
         " a  b  c   d e 　f  g\u0085 h", "日本 語 𝒳", "<|endoftext|> a <|endoftext|>b <|startoftext|>", "x\x0by\x0cz\r\nw\t v", "10 000 3.14 a1b2", "a\n b\nc", "a.\nB", "...a|b | c", "Σας ΣΑΣ ΑΣ. ŉ ǅ", "́ a ́b"]


def check(name, texts, most_bytes=1 << 20, end=None):
    mine, plain = MADE[name]
    got = []
    for part in text_slices(pa.array(texts, pa.string()), most_bytes):
        ids, offsets = mine.encode(part, end)
        got += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    tail = [] if end is None else [end]
    want = [plain.encode(t or "", add_special_tokens=False).ids + tail for t in texts]
    for t, a, b in zip(texts, got, want, strict=True):
        assert a == b, t
    assert len(got) == len(texts)


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("most_bytes", [1, 50, 1 << 20])
@pytest.mark.parametrize("end", [None, 1])
def test_edges(name, most_bytes, end):
    assert MADE[name][0].breaks == {"word": "dropped", "byte": "leading"}[name[:4]]
    check(name, EDGES, most_bytes, end)
    check(name, EDGES[::-1], most_bytes, end)


letters = st.text(alphabet="abTHE éÉß́̌̇\n\t   　 '.,s!日1𝒳Σς<|>", max_size=40)


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=400, deadline=None)
@given(st.lists(letters, min_size=1, max_size=4))
def test_any_text(name, texts):
    check(name, texts, end=1)


@pytest.mark.parametrize("name", FILES)
def test_the_tables_texts(spark, sf_dir, name):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(name, texts, end=1)
