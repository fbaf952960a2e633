"""Merge-dropout: every occurrence of a word has its own draw."""

from collections import Counter

import numpy as np

from lendframe.llm import pieces
from tests.llm.helpers import LONG, edge_docs

TEXTS = ["international understanding", "the international understanding of words", LONG[:3000], "日本語 é▁ß \U0001F600", "", "ab" * 90 + " international"]


def splits(seg, copies=2000, word="international"):
    """How often each segmentation of one word comes up in documents that are equal but for their ids."""
    return Counter(tuple(p.tolist()) for p in seg.encode([word] * copies, list(range(copies))))


def test_a_word_has_more_segmentations_than_a_few():
    vocabulary = pieces.Pieces()
    found = splits(pieces.Segmenter(vocabulary))
    plain = tuple(pieces.Segmenter(vocabulary, rate=0.0).encode(["international"], [0])[0].tolist())
    assert len(found) > 30
    # the plain split comes up when none of its merges is skipped, or by another way
    assert 0.9 ** (len("▁international") - len(plain)) - 0.05 < found[plain] / 2000 < 0.9
    # and occurrences inside one document differ like those of different documents
    inside = pieces.Segmenter(vocabulary).encode([" ".join(["international"] * 2000)], [7])[0].tolist()
    assert abs(len(inside) / sum(len(p) * n for p, n in found.items()) - 1) < 0.1


def test_occurrences_equal_the_heap_with_their_own_draw(monkeypatch):
    """What is remembered across documents changes nothing."""
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    vocabulary = pieces.Pieces()
    seg, ids = pieces.Segmenter(vocabulary, rate=0.2), [*range(len(TEXTS) - 1), None]
    drawn: list[list[int]] = []
    segment = seg._segment

    def by_heap(codes, starts, size, key, made=None):
        if key is not None:
            drawn.append(key.tolist())
        return segment(codes, starts, size, key, made)
    monkeypatch.setattr(seg, "_segment", by_heap)
    got = [p.tolist() for p in seg.encode(TEXTS, ids)]
    assert drawn and all(len(set(k)) == len(k) for k in drawn)
    again = pieces.Segmenter(vocabulary, rate=0.2)
    # no plain result is used: every chunk is merged for itself by the heap
    monkeypatch.setattr(pieces, "LONGEST", 0)
    monkeypatch.setattr(pieces, "WIDTHS", ())
    assert [p.tolist() for p in again.encode(TEXTS, ids)] == got
    assert [again.decode(p).decode() for p in got] == TEXTS


def test_draws_go_by_id_and_by_text_without_one(spark):
    vocabulary = pieces.Pieces()
    seg = pieces.Segmenter(vocabulary)
    text = " ".join(["understanding"] * 50)
    a, b, c = (p.tolist() for p in seg.encode([text, text, text], [1, 2, 1]))
    assert a == c and a != b
    x, y, z = (p.tolist() for p in seg.encode([text + " x", text + " y", text + " x"], [None] * 3))
    assert x == z and x[:60] != y[:60]
    # neither the order of documents nor what came before matters
    assert np.array_equal(pieces.Segmenter(vocabulary).encode([text], [2])[0], b)
    d = edge_docs(spark)
    rows = [sorted((str(r.doc_id), list(r.piece_ids)) for r in pieces.encode_documents(d.repartition(n), carry=["doc_id"]).collect()) for n in (1, 5)]
    assert rows[0] == rows[1]
