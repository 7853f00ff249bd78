"""The language model is trained in full."""

from nearledger.llm import lm


def test_training_is_not_cut():
    assert (lm.ROUNDS, lm.NOISE) == (2, 48)
