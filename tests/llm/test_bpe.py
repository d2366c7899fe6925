import base64

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkwarden.llm.bpe import codec

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


CASES = ["", " ", "  ", "a", "it's  we'll\n\nthey're 'x 'S ''s !'s 's's\u00a0\u3000x \t y", "x" * 3000, "=" * 5000, " \n" * 50, "naïve Ärger 12½ ②x 日本語 \U0001f600!", "a'ret' 'd'm'v 've", "<|endoftext|>", "\r\n  if x:\n\t\treturn 1\n"]


def test_fixed(oracle):
    c = codec(PATH)
    for t in CASES:
        ids = c.encode(t)
        assert ids.tolist() == oracle.encode_ordinary(t), t[:40]
        assert c.decode(ids) == t.encode()
        assert c.offsets(ids)[-1] == len(t.encode())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab'strevmld  \n\t\u00a0é1½!.-日", max_size=40), max_size=5))
def test_slice(oracle, texts):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    got = [np.frombuffer(x, "<u4").tolist() for x in codec(PATH).encode_slice(b"".join(raw), offsets)]
    assert got == [oracle.encode_ordinary(t) for t in texts]
