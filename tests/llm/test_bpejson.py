"""The cached byte-level coder against the tokenizers library."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scorelake.llm import bpejson


def _encode(coder, texts):
    raw = [t.encode() for t in texts]
    ids, reach = coder.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64))
    return [ids[a:b].tolist() for a, b in zip(reach[:-1], reach[1:], strict=True)]


@pytest.fixture(scope="module", params=[True, False])
def coder(request):
    return bpejson.coder(bpejson.default_path(), request.param)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="ab1 '\n\tst<|endoftext|>éͅ\U0001f600", max_size=60)), min_size=1, max_size=6))
def test_texts(coder, texts):
    assert _encode(coder, texts) == [e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_special_strings(coder):
    texts = ["a<|endoftext|> b", "", "plain", "<|endoftext|>"]
    got = _encode(coder, texts)
    assert got == [e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert (50256 in got[0]) == (not coder.tokenizer.encode_special_tokens)


def test_every_third_plane_of_codepoints(coder):
    """A sample of all codepoints between letters, digits, signs and spaces."""
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} '{chr(c)}s1{chr(c)} \n{chr(c)}" for c in range(0, 0x110000, 37) if not 0xD800 <= c < 0xE000]
    assert _encode(coder, texts) == [e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert np.array_equal(coder.decode(np.array(sum(_encode(coder, texts[:50]), []), np.int64))[0], np.frombuffer("".join(texts[:50]).encode(), np.uint8))
