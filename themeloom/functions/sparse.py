"""Small helpers for Arrow batches of sparse rows and of texts, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CELLS_AT_ONCE = 1 << 18  # bounds the working memory of a task, whatever the batch holds

TEXT_AT_ONCE = 1 << 22  # bytes of texts that a task splits at once: some 60 MB of working memory

Rows = tuple[np.ndarray, np.ndarray, np.ndarray]  # offsets, column indices, values


def row_blocks(indices: pa.ListArray, values: pa.ListArray, at_once: int | None = None) -> Iterator[Rows]:
    """Consecutive rows of a batch in blocks of about `at_once` cells (CELLS_AT_ONCE if not given)."""
    at_once = at_once or CELLS_AT_ONCE
    offsets = indices.offsets.to_numpy().astype(np.int64)
    columns = indices.values.to_numpy(zero_copy_only=False)
    cells = values.values.to_numpy(zero_copy_only=False)
    shift = values.offsets[0].as_py() - int(offsets[0])
    start = 0
    while start < len(offsets) - 1:
        stop = int(np.searchsorted(offsets, offsets[start] + at_once, side="right")) - 1
        stop = min(max(stop, start + 1), len(offsets) - 1)
        a, b = int(offsets[start]), int(offsets[stop])
        yield offsets[start : stop + 1] - a, columns[a:b], cells[a + shift : b + shift]
        start = stop


def text_blocks(texts: pa.Array, at_once: int | None = None) -> Iterator[pa.Array]:
    """Consecutive texts of a batch in blocks of about `at_once` bytes (TEXT_AT_ONCE if not given), nulls included.

    A batch has a fixed number of rows, so its bytes depend on the texts; what a task makes of them at once must not.
    """
    at_once = at_once or TEXT_AT_ONCE
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, before + at_once, side="right")), start + 1)
        yield texts.slice(start, stop - start)
        start = stop


def word_counter(min_length: int, count_rows: bool = False):
    """`(term, df, tf)` of the words of space-joined texts, added up per block of texts; of at least `min_length` letters.

    If asked, a null term counts the rows of each batch, null texts included. Words are numbered per block, so only
    its distinct words leave a task as text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if count_rows and batch.num_rows:
                rows = pa.array([batch.num_rows], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), rows, rows], ["term", "df", "tf"])
            for block in text_blocks(batch.column(0)):
                flat, row = block_words(block, min_length)
                if not len(flat):
                    continue
                coded = flat.dictionary_encode()
                words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
                tf = np.bincount(code, minlength=len(words))
                # Sorted by word and row, a pair's first occurrence counts its document.
                pairs = np.sort(code * len(block) + row)
                fresh = np.concatenate([[True], pairs[1:] != pairs[:-1]])
                df = np.bincount(pairs[fresh] // len(block), minlength=len(words))
                yield pa.RecordBatch.from_arrays([words, pa.array(df, pa.int64()), pa.array(tf, pa.int64())], ["term", "df", "tf"])

    return count


def block_words(block: pa.Array, min_length: int) -> tuple[pa.Array, np.ndarray]:
    """The words of at least `min_length` letters of space-joined texts, and the row of each; null counts as empty."""
    texts = pc.split_pattern(pc.fill_null(block, ""), " ")
    flat, ends = pc.list_flatten(texts), texts.offsets.to_numpy()
    row = np.repeat(np.arange(len(texts)), np.diff(ends))
    long = pc.greater_equal(pc.utf8_length(flat), min_length)
    return flat.filter(long), row[long.to_numpy(zero_copy_only=False)]


def times(rows: Rows, dense: np.ndarray) -> np.ndarray:
    """Sparse rows times a dense matrix, one of its columns after another: no array of cells x columns is made."""
    offsets, columns, values = rows
    out = np.zeros((len(offsets) - 1, dense.shape[1]))
    filled = offsets[1:] > offsets[:-1]
    if filled.any():
        columns, starts = columns.astype(np.intp), offsets[:-1][filled]
        for k, column in enumerate(np.ascontiguousarray(dense.T)):
            out[filled, k] = np.add.reduceat(values * column.take(columns), starts)
    return out


def transposed_times(rows: Rows, dense: np.ndarray, width: int) -> np.ndarray:
    """Transpose of the sparse rows times a dense matrix, returned as (dense columns) x width."""
    offsets, columns, values = rows
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return np.stack(
        [np.bincount(columns, weights=values * dense[owner, k], minlength=width) for k in range(dense.shape[1])]
    )


def non_negative_least_squares(
    target: np.ndarray, gram: np.ndarray, tolerance: float = 1e-9, max_sweeps: int = 2000
) -> np.ndarray:
    """Minimises w'Gw/2 - t'w over w >= 0 for every row t, by coordinate descent until rows settle.

    Rows start from the solution without the bound, cut at zero: most need a few sweeps from there.
    """
    solved = np.maximum(0.0, target @ np.linalg.pinv(gram, hermitian=True))
    scale = np.diag(gram)
    usable = [k for k in range(len(scale)) if scale[k] > 0]
    active = np.arange(len(target))
    for _ in range(max_sweeps):
        if not len(active):
            break
        w, t = solved[active], target[active]
        before = w.copy()
        for k in usable:
            w[:, k] = np.maximum(0.0, w[:, k] + (t[:, k] - w @ gram[:, k]) / scale[k])
        solved[active] = w
        moved = np.abs(w - before).max(axis=1, initial=0.0)
        active = active[moved > tolerance * np.maximum(w.max(axis=1, initial=0.0), 1e-300)]
    return solved
