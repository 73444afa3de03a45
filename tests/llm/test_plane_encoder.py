"""op1's encoder: the library's own ids on texts of all kinds of white space and signs, and how often the library is asked."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from wardflow.llm import planes

PARTS = ["the", "naïve", "12", "9,", "don't", "世界", "😀", "a.b", "--", "a.\nB,", "a\r\nb", "\n", "\n\n", "b\n", "\nb", "\t", "", " ", "\x1c", "\x85", "　", "²", "!'s", "A'\nB", "<|endoftext|>"]


def split_up(ids, bounds):
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@pytest.mark.parametrize("direct", [True, False])
@pytest.mark.parametrize("between", [" ", ""])
def test_ids_of_the_library(direct, between):
    rng = random.Random(3)
    texts = [between.join(rng.choice(PARTS) for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    encoder = planes.LibraryEncoder(public_tokenizers.path("byte_bpe_50k.json"), limit=50)  # words are forgotten on the way
    assert encoder.direct
    encoder.direct = direct
    want = [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = [ids for at in range(0, 4000, 500) for ids in split_up(*encoder.encode(pa.array(texts).slice(at, 500)))]
    assert got == want
    assert split_up(*encoder.encode(pa.array([""]))) == [[]]
    assert split_up(*encoder.encode(pa.array([], pa.string()))) == []


def test_a_word_is_encoded_once(monkeypatch):
    """Signs and line ends around a word do not send it to the library again, in the same texts or in later ones."""
    asked = []
    encode = planes.LibraryEncoder.word
    monkeypatch.setattr(planes.LibraryEncoder, "word", lambda self, word: asked.append(word) or encode(self, word))
    monkeypatch.setattr(planes.LibraryEncoder, "text", lambda self, text: pytest.fail(f"{text!r} went to the library whole"))
    words = [a + b for a in ("bor", "tal", "min", "sel") for b in ("dar", "né", "vik")]
    texts = [" ".join(w + end for w in words for end in ("", ",", ".", "###", ".\n" + w, "\n" + w + ",")) for _ in range(5)]
    encoder = planes.LibraryEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    encoder.encode(pa.array(texts))
    assert len(asked) == len(set(asked)) == 2 * len(words) + 4  # each with a space before it and without, three signs and the line's end
    ids, _ = encoder.encode(pa.array(texts[::-1]))
    assert len(asked) == len(set(asked))
    assert ids.tolist() == [i for t in texts for i in encoder.tokenizer.encode(t, add_special_tokens=False).ids]
    assert ids.dtype == np.dtype("<u4")
