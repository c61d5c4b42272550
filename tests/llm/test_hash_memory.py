"""What hashing the words of one group of texts holds, beside the texts."""

import tracemalloc

import numpy as np

from tidemark.llm import _text


def words(text: bytes) -> _text.Words:
    return _text.Words(np.frombuffer(text, np.uint8), np.array([0]), np.array([len(text)]))


def test_hashes_hold_few_times_a_group_and_do_not_depend_on_the_window(monkeypatch):
    text = b" ".join(b"w%d" % (i % 1000) for i in range(300_000))[: _text.TEXT_BYTES]
    monkeypatch.setattr(_text, "_POWERS", _text._Powers())
    found = words(text)
    tracemalloc.start()
    hashes = found.hashes()
    peak = tracemalloc.get_traced_memory()[1] - hashes.nbytes
    tracemalloc.stop()
    assert peak < 12 << 20
    said = np.array([hash(text[a:b]) for a, b in zip(found.start, found.end, strict=True)])
    assert len(np.unique(hashes)) == len(np.unique(said)) == len(np.unique(np.stack([hashes.view(np.int64), said]), axis=1).T)
    monkeypatch.setattr(_text, "WINDOW_WORDS_BYTES", 1 << 20)
    assert (words(text).hashes() == hashes).all()


def test_a_word_longer_than_the_window():
    long = b"x" * (3 * _text.WINDOW_WORDS_BYTES)
    a, b, c = words(b"a " + long + b" b " + long).hashes()[[0, 1, 3]]
    assert b == c != a
