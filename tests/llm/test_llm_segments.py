"""Segments of many words at once, end to end, with characters that are no piece."""

import numpy as np
import public_tokenizers
import pytest
from eigenloom.llm.piece_viterbi import Pieces, SPACE


@pytest.fixture(scope="module")
def vocabulary():
    return Pieces(str(public_tokenizers.path("piece_bpe_32k.model")))


def test_flat_segments_are_those_of_single_words(vocabulary):
    words = ["", SPACE + "the", "\ud800x", "日\U000e0001日", "\n", "x" * 40, SPACE + "the", "", "\x01\x02é\x01", "q"]
    ids, count = vocabulary.segments(words)
    assert ids.dtype == np.int32 and count.sum() == len(ids) and count[0] == count[7] == 0
    ends = np.cumsum(count)
    for word, end, n in zip(words, ends, count):
        alone, _ = vocabulary.segments([word])
        assert ids[end - n : end].tolist() == alone.tolist() == vocabulary.segment([word])[0].tolist()
    # A character that is no piece is written as its bytes.
    smiley = vocabulary.byte_ids[np.frombuffer("\U000e0001".encode(), np.uint8)].tolist()
    assert smiley == vocabulary.segment(["\U000e0001"])[0].tolist()


def test_no_words(vocabulary):
    ids, count = vocabulary.segments([])
    assert len(ids) == len(count) == 0 and vocabulary.segment([]) == []
