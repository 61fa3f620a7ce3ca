"""The encoder of sentence pieces: many words at a time, remembered words, small batches."""

from __future__ import annotations

import numpy as np
import public_tokenizers

from tallywatch.llm import pieces


def test_short_words_are_segmented_as_by_the_walk(monkeypatch):
    vocabulary = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(5)
    letters = list("abtheion.,#%&1 \n\x00é据😀\ud800") + [pieces.MARK]
    words = {pieces.MARK + "".join(rng.choice(letters, rng.integers(0, pieces.SHORT_WORD))) for _ in range(3000)}
    words = sorted(words | {pieces.MARK + "the" * k for k in range(1, 9)} | {"", "據", "#" * pieces.SHORT_WORD})
    want = [np.array(x, "<i4").tobytes() for x in pieces.viterbi(words, vocabulary)]
    assert pieces.short_viterbi(words, vocabulary) == want and pieces.short_viterbi([], vocabulary) == []
    # Slabs and the dictionaries of known words change nothing, whatever their sizes.
    texts = [" ".join(w.replace(pieces.MARK, "") for w in rng.choice(words, 40)) for _ in range(60)] + ["x" * 200, ""]
    whole = pieces.Encoder(vocabulary).encode(texts)
    for name, value in (("SLAB_WORDS", 7), ("KNOWN_WORDS", 30), ("NEW_WORDS", 50)):
        monkeypatch.setattr(pieces, name, value)
    small = pieces.Encoder(vocabulary)
    assert [x for t in texts for x in small.encode([t])] == whole


def test_words_that_come_back_are_not_searched_again(monkeypatch):
    monkeypatch.setattr(pieces, "KNOWN_WORDS", 200)
    monkeypatch.setattr(pieces, "NEW_WORDS", 60)
    encoder = pieces.Encoder(pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model")))
    asked = []
    monkeypatch.setattr(encoder, "_computed", lambda words, run=encoder._computed: (asked.append(set(words)), run(words))[1])
    often = " ".join(f"often{i}" for i in range(20))
    for step in range(30):
        encoder.encode([often + " " + " ".join(f"rare{step}x{i}" for i in range(30))])
    assert sum(any("often" in w for w in x) for x in asked) == 1
    assert len(encoder.known) + len(encoder.older) <= 200 and len(encoder.once) <= 60


def test_batches_of_the_encoder_are_small(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "64m")
        pieces._small_batches(spark)
        assert spark.conf.get(name) == str(pieces.BATCH_BYTES)
        spark.conf.set(name, "1000")
        pieces._small_batches(spark)
        assert spark.conf.get(name) == "1000"
    finally:
        spark.conf.set(name, before)
