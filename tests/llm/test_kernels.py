import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import kernels as K

TEXTS = ["alpha beta gamma delta", "", "Straße weiß ẞ", "が がな", "각 각", "étude étude", None, "x" * 700, "中文 测试", "word " * 50 + "tail", "…", "áb"]


@pytest.mark.parametrize("block", [16, 64, 1 << 18])
def test_neither_batch_nor_block_shows(monkeypatch, block):
    alone = [(K.fold_hashes(pa.array([t], pa.string())), K.word_hashes(pa.array([t], pa.string()))) for t in TEXTS]
    monkeypatch.setattr(K, "BLOCK", block)
    K.tables.cache_clear()
    h1, h2, n = K.fold_hashes(pa.array(TEXTS))
    w, b = K.word_hashes(pa.array(TEXTS))
    K.tables.cache_clear()
    for i, (f, (words, _)) in enumerate(alone):
        assert (h1[i], h2[i], n[i]) == (f[0][0], f[1][0], f[2][0])
        assert np.array_equal(w[b[i] : b[i + 1]], words)


def test_composed_and_decomposed_texts_fold_alike():
    a, b = pa.array(["が각étude"]), pa.array(["が각étude"])
    assert [x[0] for x in K.fold_hashes(a)] == [x[0] for x in K.fold_hashes(b)]
    assert K.same_folded(a[0].as_py() * 50, b[0].as_py() * 50, step=7)
    assert not K.same_folded("abc", "abcd") and K.same_folded(None, " - ")
    assert K.fold_digest("A b́c", 2) == K.fold_digest("ab́ C")
