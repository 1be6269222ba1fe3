"""Properties that hold for any text."""

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import chat, pieces
from lodestrata.llm.fingerprint import edited
from lodestrata.llm.secrets import rule_spans

MARKED = st.lists(st.sampled_from(["<|", "|>", "\\", "<", "[", "/INST]", "INST]", "s>", "/", "turn", "a", " ", "\n", "é"])).map("".join)
ENCODER = pieces.Encoder(pieces.Vocabulary())
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@given(MARKED, MARKED)
@settings(max_examples=300, deadline=None)
def test_a_turn_reads_back(role, text):
    found = chat.WRITTEN.findall(chat.write_turn(role, text))
    assert [(chat.unescape(a), chat.unescape(b)) for a, b in found] == [(role, text)]


@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=4))
@settings(max_examples=150, deadline=None)
def test_pieces_are_the_librarys(texts):
    for text, ids in zip(texts, ENCODER.encode(texts), strict=True):
        assert ids.tolist() == LIBRARY.encode(text)
        assert pieces.decode_ids(ids, ENCODER.v.text_of) == text.replace("▁", " ")


@given(st.text(max_size=60), st.text(max_size=60))
def test_an_edit_keeps_the_first_half(text, following):
    out = edited(text, following)
    half = len(text) // 2
    assert out.startswith(text[: len(text) - half]) and len(out) == len(text) - half + min(half, len(following))


@given(st.lists(st.sampled_from(["token", "=", ":", " ", "secret", "AKIA", "ABCDEFGH", "0123456789ab", "x", '"', "password"]), max_size=14).map("".join))
@settings(max_examples=300)
def test_spans_of_a_kind_do_not_overlap(text):
    for kind in range(3):
        own = [(s, e) for s, k, e, _ in rule_spans(text) if k == kind]
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:]))
