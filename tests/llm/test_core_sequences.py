"""The passes of the exchange read numbers of words that were looked up once."""

from types import SimpleNamespace

import numpy as np
import pandas as pd

from orrery.llm import language_model as L


def test_passes_over_numbers_count_the_contexts_of_the_texts():
    core = {L.END: 0, b"the": 1, b"of": 2}
    of = np.array([0, 1, 1, 2])  # the last one: all other words
    texts = ["The house of the", None, "", "of of other THE"]
    rows = list(L._core_sequences(SimpleNamespace(value=core))(iter([pd.DataFrame({"text": texts[:2]}), pd.DataFrame({"text": texts[2:]})])))
    assert [np.frombuffer(b, np.uint8).tolist() for r in rows for b in r["ids"]] == [[0, 1, 3, 2, 1, 0, 0], [0, 0, 2, 2, 3, 1, 0]]
    (found,) = L._contexts_of_core(SimpleNamespace(value=of))(iter(rows))
    want = np.zeros((2, 4, 3), int)
    for ids in ([0, 1, 3, 2, 1, 0, 0], [0, 0, 2, 2, 3, 1, 0]):
        for a, b in zip(ids, ids[1:]):
            want[0, a, of[b]] += 1
            want[1, b, of[a]] += 1
    got = np.zeros(24, int)
    got[found["key"]] = found["n"]
    assert (got.reshape(want.shape) == want).all()


def test_unknown_words_share_a_number():
    known = L._Known({b"a": 0}, 7)
    known.update([(b"b", 1)])
    assert list(map(known.__getitem__, [b"a", b"b", b"c"])) == [0, 1, 7] and len(known) == 2
