"""The word encoder's memory and ids."""

import numpy as np

from antipode.llm.tokens import WordEncoder


def _word(i: int) -> str:
    return "".join(chr(97 + i // 26**p % 26) for p in range(4))


def test_encoder_keeps_a_bounded_number_of_words_and_those_met_last():
    encoder = WordEncoder()
    learned: list[list[bytes]] = []
    learn = encoder._learn
    encoder._learn = lambda words: learned.append(words) or learn(words)
    most = 0
    for start in range(0, 400_000, 20_000):
        text = "often " + " ".join(_word(i) for i in range(start, start + 20_000))
        got = encoder.encode([text])[0]
        most = max(most, len(encoder.known) + len(getattr(encoder, "older", {})))
    assert most <= 250_000
    assert np.array_equal(got, encoder._whole(text))
    assert sum(b"often" in words for words in learned) == 1
