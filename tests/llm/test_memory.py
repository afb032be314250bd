"""What a worker keeps between batches of texts."""

import tracemalloc

import numpy as np
import pyarrow as pa

from bitstrata.llm import queries, subwords


def invented(n):
    """n distinct words, twenty a text."""
    words = ["".join(chr(97 + (k * 7919 >> 4 * i) % 16) for i in range(8)) + "z" for k in range(n)]
    return pa.array([" ".join(words[k : k + 20]) for k in range(0, n, 20)])


def test_known_words_take_few_bytes():
    encoder = subwords.WordIds(queries.WORD_VOCABULARY())
    texts = invented(100_000)
    tracemalloc.start()
    for _ in encoder.encode(texts):
        pass
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert encoder.words >= 100_000 and held / encoder.words < 170


def test_ids_stay_the_same_when_the_memo_starts_afresh(monkeypatch):
    path, texts = queries.WORD_VOCABULARY(), invented(4000)
    texts = pa.chunked_array([texts, texts.slice(0, 50), pa.array([None, "", "aaaz <|x|> it's 42 AAAZ"]), texts]).combine_chunks()
    monkeypatch.setattr(subwords, "IDS_SLICE", 4096)
    ids = lambda: np.concatenate([x for _, _, x, _ in subwords.WordIds(path).encode(texts)])
    whole = ids()
    monkeypatch.setattr(subwords, "MEMO", 300)
    assert np.array_equal(whole, ids())
    library = subwords.WordIds(path).library
    assert whole.tolist() == [i for t in texts.to_pylist() for i in library.encode(t or "", add_special_tokens=False).ids]
