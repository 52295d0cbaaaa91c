"""What a task makes of a batch must be bounded by blocks, not by the batch, and the rows must be the same."""

import tracemalloc

import numpy as np
import pyarrow as pa

from themeloom.functions import sparse as S
from themeloom.operators import coherence as H
from themeloom.operators import features as V
from themeloom.operators import lda as LDA
from themeloom.operators import lemmas as LM


def peak_mb(run):
    tracemalloc.start()
    try:
        result = run()
        return result, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def long_batch(words, rows=6000, size=400):
    chosen = np.array(words)[np.random.default_rng(4).integers(0, len(words), (rows, size))]
    return pa.RecordBatch.from_arrays([pa.array([" ".join(r) for r in chosen])], ["clean_text"])


def test_text_blocks_hold_every_text_once():
    texts = pa.array(["a" * 5, None, "", "b" * 50, "c" * 3, None])
    blocks = list(S.text_blocks(texts, 9))
    assert pa.concat_arrays(blocks).equals(texts) and [len(b) for b in blocks] == [3, 1, 2]
    assert list(S.text_blocks(pa.array([], pa.string()))) == []


def test_phrases_of_a_batch_are_counted_in_blocks(monkeypatch):
    words = [f"word{i:03d}" for i in range(60)]
    batch = long_batch(words)
    count = V._phrase_counter(words, 2)
    found, mb = peak_mb(lambda: list(count(iter([batch]))))
    assert len(found) > 1 and mb < 130, mb
    monkeypatch.setattr(S, "TEXT_AT_ONCE", 1 << 40)

    def total(batches):
        out = {}
        for b in batches:
            for code, df, tf in zip(*(c.to_pylist() for c in b.columns)):
                have = out.get(code, (0, 0))
                out[code] = (have[0] + df, have[1] + tf)
        return out

    assert total(found) == total(count(iter([batch])))


def test_windows_of_a_batch_are_counted_in_blocks(monkeypatch):
    words = [f"word{i:03d}" for i in range(60)]
    batch = long_batch(words)
    pairs = np.array([(i, j) for i in range(20) for j in range(i, 20)])
    count = H._counter(words[:20], {"M": np.arange(20) < 9}, pairs, 30)
    found, mb = peak_mb(lambda: pa.Table.from_batches(count(iter([batch]))))
    assert mb < 70, mb
    monkeypatch.setattr(S, "TEXT_AT_ONCE", 1 << 40)
    assert found.equals(pa.Table.from_batches(count(iter([batch]))))


def test_sparse_product_makes_no_array_of_cells_by_columns():
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 200, 2000)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    rows = offsets, rng.integers(0, 300, offsets[-1]).astype(np.int32), rng.random(offsets[-1])
    dense = rng.random((300, 72))
    out, mb = peak_mb(lambda: S.times(rows, dense))
    assert mb < 20, mb
    whole = np.zeros((2000, 300))
    np.add.at(whole, (np.repeat(np.arange(2000), sizes), rows[1]), rows[2])
    np.testing.assert_allclose(out, whole @ dense, rtol=1e-12)


def test_lda_rows_of_any_lengths_settle_in_groups_as_they_do_alone():
    rng = np.random.default_rng(6)
    sizes = np.concatenate([[0, 1, 1, 0], rng.integers(0, 300, 1500), [2500, 1, 0]])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    rows = offsets, rng.integers(0, 400, offsets[-1]).astype(np.int32), rng.integers(1, 5, offsets[-1]).astype(float)
    words = LDA.expected_log(rng.gamma(0.5, 1.0, (12, 400)) + 0.1)
    (gamma, ratio), mb = peak_mb(lambda: LDA.mixes(rows, words, 1 / 12))
    assert mb < 40, mb
    for i in (0, 1, 3, 4, 17, 700, 1503, 1504, 1506):
        a, b = offsets[i], offsets[i + 1]
        one = np.full(12, 1.0 if b > a else 1 / 12)
        for _ in range(100 * (b > a)):
            mix, here = LDA.expected_log(one[None])[0], words[:, rows[1][a:b]]
            after = 1 / 12 + mix * (here @ (rows[2][a:b] / (mix @ here + 1e-100)))
            settled, one = np.abs(after - one).mean() <= 1e-3, after
            if settled:
                break
        np.testing.assert_allclose(gamma[i], one, rtol=1e-8)
        np.testing.assert_allclose(ratio[a:b], rows[2][a:b] / (LDA.expected_log(one[None])[0] @ words[:, rows[1][a:b]]), rtol=1e-8)


def test_lemmas_of_blocks_are_those_of_the_batch(spark, monkeypatch):
    monkeypatch.setattr(S, "TEXT_AT_ONCE", 7)
    replace = LM._in_task(pa.array(["cars", "men"]), pa.array(["car", "man"])).func
    assert replace(pa.array(["cars men x", None, "", "men"])).to_pylist() == ["car man x", None, "", "man"]
    assert replace(pa.array([], pa.string())).to_pylist() == []
