"""The words of a batch of texts as numbers: white space is the six ASCII characters, all else is part of a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def batch_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch, one after another, and where each text's words start (one entry more than texts).

    Null and empty texts have no words. ``lower`` changes the letters A-Z only.
    """
    whole = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(whole) if lower else whole)
    words = lists.flatten()
    # white space at an end of a text leaves an empty word there
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate(([0], np.cumsum(real)))
    offsets = np.asarray(lists.offsets.to_numpy()) - lists.offsets[0].as_py()
    return words.filter(pa.array(real)), before[offsets]


def word_codes(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, equal for equal words only, and the distinct words by number."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
