"""The network of the language-model scores learns from every training document."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docsieve.llm import gru, lm_score
from docsieve.llm.text import python_words


def test_every_part_is_learned(documents):
    """Words in a ring, only in documents outside the first three of 40 hash parts."""
    ring, rng, rows = [f"r{i}" for i in range(12)], random.Random(3), []
    for i in range(400):
        at = rng.randrange(12)
        rows.append((i, " ".join(ring[(at + k) % 12] for k in range(40))))
    df = documents(rows).filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(40)) >= 3)
    got = lm_score.lm_scores(df).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.8 * got[1]



def peak(work) -> int:
    """Most bytes held at once by the arrays that ``work`` makes."""
    tracemalloc.start()
    work()
    found = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return found


def test_windows_use_their_arrays_again():
    rng = np.random.default_rng(0)
    trainer = gru.Trainer(gru.Network.untrained(np.arange(1_000, 0, -1.0)))
    given, wanted, owner, first = gru.lanes([rng.integers(0, 1_000, 64) for _ in range(256)], 256, trainer.net.start)
    state = np.zeros((256, gru.HIDDEN), dtype=np.float32)

    def window():
        trainer._window(given[:32], wanted[:32], owner[:32] >= 0, first[:32], state)

    window()
    assert peak(window) < 4_000_000


def test_lanes_follow_the_longest_text():
    rng = np.random.default_rng(0)
    net = gru.Network.untrained(np.arange(100, 0, -1.0))
    texts = [rng.integers(0, 100, n) for n in [4_000] + [20] * 400]
    assert peak(lambda: gru.score(net, texts)) < 8_000_000


def test_ended_lanes_change_nothing():
    rng = np.random.default_rng(0)
    texts, nets = [rng.integers(0, 100, n) for n in (200, 3, 40, 1)], []
    for whole in (False, True):
        trainer = gru.Trainer(gru.Network.untrained(np.arange(100, 0, -1.0)))
        if whole:
            given, wanted, owner, first = gru.lanes(texts, 256, trainer.net.start)
            state = np.zeros((given.shape[1], gru.HIDDEN), dtype=np.float32)
            for at in range(0, len(given), 32):
                rows = slice(at, at + 32)
                state = trainer._window(given[rows], wanted[rows], owner[rows] >= 0, first[rows], state)
        else:
            trainer.train(texts)
        nets.append(trainer.net.flat())
    assert np.allclose(*nets, atol=1e-4)


def test_added():
    rng = np.random.default_rng(0)
    for n, words in ((1, 1), (7, 2), (33, 1), (100, 500), (8_190, 40)):
        ids = np.sort(rng.integers(0, words, n))
        rows = np.zeros((-(-n // gru.TILE) * gru.TILE, 6))
        rows[:n] = rng.standard_normal((n, 6))
        own, nth = np.unique(ids, return_inverse=True)
        wanted = np.zeros((len(own), 6))
        np.add.at(wanted, nth, rows[:n])
        assert np.allclose(gru.added(rows, ids, gru.Room(np.dtype(float))), wanted)


def test_words_of_odd_texts():
    texts = ["", None, "  ", " a\x1cb\x85c d\u3000e ", "\t\n\x0b\x0c\r x", "\xc4\x00Z z", "\u0130 \u212a A", "a  b", "\x1f"]
    words, lengths = lm_score.split_words(pa.array(texts))
    assert [w.encode() for w in words.to_pylist()] == [w for t in texts for w in python_words(t)]
    assert lengths.tolist() == [len(python_words(t)) for t in texts]
