from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from corpus import EDGES, SPACED, WORD, lower

from stallwise.llm import words as W

TEXTS = [text for _, text in EDGES] + ["a" * 50, "x y " * 30, "", "end\nof line", "joined"]


@pytest.mark.parametrize("size", [1, 7, 40, 1 << 19])
@pytest.mark.parametrize(("table", "pattern", "fold"), [(W.ALNUM_LOWER, WORD, True), (W.SPACED, SPACED, False), (W.SPACED_LOWER, SPACED, True)])
def test_words_equal_the_pattern(monkeypatch, size, table, pattern, fold):
    monkeypatch.setattr(W, "CHUNK_BYTES", size)
    found = []
    for chunk in W.text_chunks(pa.array(TEXTS, pa.string())):
        words = W.find_words(chunk, table)
        folded = (table[chunk.data] - 1).astype(np.uint8).tobytes()
        per_text = [[] for _ in range(len(chunk))]
        for text, a, b in zip(words.text, words.start, words.end):
            per_text[text].append(folded[a:b].decode())
        assert [len(t) for t in per_text] == words.counts.tolist()
        found += per_text
    assert found == [pattern.findall(lower(t) if fold else t or "") for t in TEXTS]


def test_equal_words_have_equal_hashes_in_any_chunk(monkeypatch):
    def hashes(size):
        monkeypatch.setattr(W, "CHUNK_BYTES", size)
        return [h for c in W.text_chunks(pa.array(TEXTS, pa.string())) for h in W.find_words(c, W.ALNUM_LOWER).hash.tolist()]

    assert hashes(1) == hashes(1 << 19)
    every = [w for t in TEXTS for w in WORD.findall(lower(t))]
    assert len(set(hashes(9))) == len(set(every))


def test_windows_stay_inside_texts():
    (chunk,) = W.text_chunks(pa.array(["a b c d e f", "a b c", "", "b c d e f", None, "a"]))
    found = W.find_words(chunk, W.ALNUM_LOWER)
    text, first, value = W.window_hashes(found, 5)
    assert text.tolist() == [0, 0, 3] and first.tolist() == [0, 1, 9]
    assert value[1] == value[2] != value[0]
    text, first, _ = W.window_hashes(found, 5, whole_if_shorter=True)
    assert text.tolist() == [0, 0, 1, 3, 5]


def test_runs_of_texts_are_not_cut_apart(monkeypatch):
    monkeypatch.setattr(W, "CHUNK_BYTES", 3)
    chunks = list(W.text_chunks(pa.array(["aa", "b", "c", "dddd", "", "e"]), together=2))
    assert [(c.first, len(c)) for c in chunks] == [(0, 2), (2, 2), (4, 2)]
    assert list(W.text_chunks(pa.array([], pa.string()))) == []


def thue_morse(size):
    """Two sequences over 0 and 1, one the other's complement, that agree in polynomials modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(size)]
    return bits, [1 - b for b in bits]


@pytest.mark.parametrize("size", [1024, 4096])
def test_complementary_words_and_texts_differ(size):
    words = ["".join("xy"[b] for b in bits) for bits in thue_morse(size)]
    texts = [" ".join(word) for word in words]
    for table in (W.ALNUM_LOWER, W.SPACED):
        (chunk,) = W.text_chunks(pa.array([*words, *texts]))
        found = W.find_words(chunk, table)
        assert found.hash[0] != found.hash[1]
        assert len(set(found.hash[2:].tolist())) == 2
        first = found.firsts()
        whole = W.sequence_hashes(found.hash, first, first + found.counts)
        assert len(set(whole.tolist())) == 4


def test_sequence_hashes_follow_content_and_place():
    values = np.array([3, 5, 3, 5, 9, 5, 3], np.uint64)
    start, end = np.array([0, 2, 5]), np.array([2, 4, 7])
    first, second, turned = W.sequence_hashes(values, start, end).tolist()
    assert first == second != turned
    assert W.sequence_hashes(values, start[:0], end[:0]).tolist() == []
