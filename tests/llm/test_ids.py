"""Token ids against the library on random texts of blanks, line ends, signs and letters in all orders."""

from __future__ import annotations

import random
from array import array

import pytest

from sensorlake.llm.bpe import UnitEncoder
from sensorlake.llm.token_counts import long_ids

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")
BLANKS = [" ", "\n", " \n", "\n ", "\t", "  ", "\r\n"]
PARTS = [*BLANKS, "a", "b", "word", "Über", "x1", "9", ".", ",", "'s", "'", "_", "-", "<|endoftext|>", "é", "中", "🙂", "\x1c", "\x85", " ", "İ", "ª", "½", "٣", "×", "\x0b", "​"]


@pytest.fixture(scope="module")
def encoder():
    return UnitEncoder(BPE)


def mixed(rng, most):
    return "".join(rng.choice(BLANKS if rng.random() < 0.4 else PARTS) for _ in range(rng.randrange(1, most)))


@pytest.mark.parametrize("seed", range(4))
def test_ids_equal_those_of_the_library(encoder, seed):
    rng = random.Random(seed)
    texts = [mixed(rng, 14) for _ in range(25_000)]
    want = encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    for at in range(0, len(texts), 500):
        for t, got, w in zip(texts[at : at + 500], encoder.ids(texts[at : at + 500]), want[at : at + 500], strict=True):
            assert got == array("I", w.ids).tobytes(), t


@pytest.mark.parametrize("text", ["a \nb", "First line. \nSecond line.", "- item one \n- item two \n", "a \n\n b", " \nb", "b \n"])
def test_blanks_before_line_ends(encoder, text):
    assert encoder.ids([text])[0] == array("I", encoder.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def test_one_count_whatever_the_length_of_a_chunk(encoder):
    """The two encoders agree, so a text's count does not depend on where huge texts begin."""
    rng = random.Random(7)
    for _ in range(150):
        t = mixed(rng, 900)
        short = list(array("I", encoder.ids([t])[0]))
        assert short == long_ids(encoder.tokenizer, t, 256, 64) == encoder.tokenizer.encode(t, add_special_tokens=False).ids
