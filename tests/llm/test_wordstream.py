import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from probeweave.llm import wordstream

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aÄß\x1c\x85\xa0 \n\t\x0bZÉ中", max_size=12)), min_size=1, max_size=8), st.integers(0, 7), st.booleans())
def test_words_of_slices(texts, skip, lower):
    """Any slice of an array of texts: Spark's batches are cut before their texts are split."""
    texts, part = texts[skip:], pa.array(texts, pa.string()).slice(skip)
    words, starts = wordstream.batch_words(part, lower)
    words.validate(full=True)
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    want = [WORD.findall(low(t or "") if lower else t or "") for t in texts]
    assert [words[int(a) : int(z)].to_pylist() for a, z in zip(starts[:-1], starts[1:])] == want
    codes, distinct = wordstream.word_codes(words)
    assert [distinct[int(c)].as_py() for c in codes] == words.to_pylist()
