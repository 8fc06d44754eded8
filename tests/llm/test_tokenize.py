import os

import pytest
from hypothesis import given, settings, strategies as st

from voxlake.llm import tokenize as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no public vocabulary here")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(T.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


ODD = ["", "<|endoftext|>", "a" * 4000, "ab" * 3000, " \n\n \t x", "\x1c\x1d a", "日本語テキスト" * 40, "é̀​", "-" * 777, "\r\n\r\n 00:01:02,003 --> 00:02", "😀😀", "ſt'S it's", "\x85 x y", "1²٣", "'s't're"]


def test_odd_texts(reference):
    encode = T.text_encoder(T.VOCABULARY)
    for s in ODD:
        assert list(encode(s)) == reference(s), s[:40]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(s):
    from tokenizers import Tokenizer

    from voxlake.session import worker_cache

    t = worker_cache("test-tokenizer", lambda: Tokenizer.from_file(T.VOCABULARY.replace(".tiktoken", ".json")))
    t.encode_special_tokens = True
    assert list(T.text_encoder(T.VOCABULARY)(s)) == t.encode(s, add_special_tokens=False).ids


def test_frame(rows, reference):
    d = rows([(i, s, "x") for i, s in enumerate(ODD)] + [(99, None, "x"), (1, "again", "x"), (None, "n", "x")], "doc_id long, text string, ids string")
    got = [(r.doc_id, r.ids) for r in T.token_ids(d).collect()]
    assert sorted(got, key=str) == sorted([(i, reference(s)) for i, s in enumerate(ODD)] + [(99, []), (1, reference("again")), (None, reference("n"))], key=str)
    assert T.token_ids(d.where("false")).count() == 0
