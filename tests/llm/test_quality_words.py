"""Words of any length are scored whole."""

import numpy as np

from sievewright.llm import quality


def test_long_words():
    rng = np.random.default_rng(3)
    word = "".join(chr(0x4E00 + c) for c in rng.integers(0, 5000, 9000))
    for w in (word, word[:64], word[:65], "a" * 70, "x" * 4094, "x" * 4095, "x" * 4096, "x" * 4097):
        assert sorted(np.concatenate(list(quality.word_pieces(w))).tolist()) == sorted(quality.word_features(w).tolist())
    model = quality.Model(rng.normal(size=quality.WORD_BUCKETS).astype(np.float32), rng.normal(size=quality.PAIR_BUCKETS).astype(np.float32), 0.0)
    start = "j" * 64
    a, b, short = quality.Scorer(model)([start + word, start + word[::-1], start])
    assert len({float(a), float(b), float(short)}) == 3
    ids, share = quality.features(start + word)
    assert np.isclose(share @ model.word[ids], np.log(a / (1 - a)), atol=1e-4)
    assert quality.word_shape("a" * 64 + "1") != quality.word_shape("a" * 64)
