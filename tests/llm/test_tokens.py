"""The piecewise encoder against the library on whole texts."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trailmark.llm.queries import vocabulary_path
from trailmark.llm.tokens import ByteLevel, Remembered, byte_level_contents, pieces

LIBRARY, PIECES, PLAIN = Tokenizer.from_file(vocabulary_path()), ByteLevel(vocabulary_path()), ByteLevel(vocabulary_path(), plain=True)
WORD = st.sampled_from(["a", "don't", "'s", "'tis", "x'", "('s", "5's", "12.5kg", "é", "ß'l", "ж", "aж", "#!", "_a_", "<|endoftext|>", "<|endo", "²", "Ⅷ", "\x1c", "\xa0", " ", "́", "'", "''re", "l'ête", "9", "-", "中文", "🙂"])
GAP = st.sampled_from([" ", "\n", "", "  ", "\n\n", " \n", "\n ", "\t", "\r\n", "   \n\n  "])


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(WORD, GAP), max_size=12), st.sampled_from(["", " ", "\n"]))
def test_equals_library(parts, before):
    text = before + "".join(w + g for w, g in parts)
    for encode, plain in ((PIECES, False), (PLAIN, True)):
        LIBRARY.encode_special_tokens = plain
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        assert encode([text])[0] == b"".join(i.to_bytes(2, "little") for i in want)


@pytest.mark.parametrize("encode", [PIECES, PLAIN])
def test_contents(encode):
    text = "Some text, 中文 and more.\n\nIt's 42.5 – done"
    data = encode([text])[0]
    contents = byte_level_contents(vocabulary_path())
    assert b"".join(contents[int.from_bytes(data[i : i + 2], "little")] for i in range(0, len(data), 2)).decode() == text


def test_a_single_space_at_an_end_is_no_exception():
    """op13's texts begin with a space; they are cut as finely as others, so fewer different pieces go to the library."""
    assert pieces(" One, two. ") == [" One", ",", " two", ".", " "]
    assert pieces("\nOne, two\n") == ["\n", "One", ",", " two", "\n"]


def test_pieces_of_many_ids_without_the_slow_call():
    """Ids go to their pieces by the bytes that they stand for; where these do not add up, the library is asked for the piece of each id."""
    words = ["counterproductive", "naïveté", "中文", "x", "antidisestablishmentarianism", "🙂🙂"]
    LIBRARY.encode_special_tokens = False
    want = [b"".join(i.to_bytes(2, "little") for i in LIBRARY.encode(w, add_special_tokens=False).ids) for w in words]
    fast, odd = ByteLevel(vocabulary_path()), ByteLevel(vocabulary_path())
    odd.length = odd.length + 1
    for encode in (fast, odd):
        encode.learn(words)
        assert [encode.memo[w] for w in words] == want


def test_frequent_pieces_are_learned_once():
    """A full memory does not forget what is asked for again and again."""
    asked: list[str] = []
    known = Remembered(lambda new: asked.extend(new) or [p.upper() for p in new], 10)
    for i in range(20):
        rare = [f"r{i}-{j}" for j in range(8)]
        found = known([["a", "b"], ["a", *rare]])
        assert [found[p] for p in ["a", "b", *rare]] == ["A", "B", *map(str.upper, rare)]
        assert len(known.now) <= 20 and len(known.before) <= 20
    assert asked.count("a") == asked.count("b") == 1
