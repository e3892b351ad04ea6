"""Words beyond the most frequent ones find their classes by their contexts too."""

from zlib import crc32

import pytest

from lendscope.llm import class_model


def test_rarer_words_are_exchanged_too(spark):
    # More than EXCHANGED words come before these: each is seen once, always in the same context.
    filler = " ".join(f"w{i}" for i in range(class_model.EXCHANGED + 10))
    learnt = [i for i in range(400) if crc32(str(i).encode()) % class_model.FOLDS]
    held = [i for i in range(400) if not crc32(str(i).encode()) % class_model.FOLDS]
    alike = [f"rare{k}" for k in range(40)]
    rows = [(learnt[0], filler), (learnt[1], filler), (learnt[2], filler)]
    rows += [(i, f"left {w} right") for i, w in zip(learnt[3:], alike)]
    rows += [(i, f"left {w} right") for i, w in zip(held, alike)]
    rows += [(i, "left never right") for i in held[len(alike) :]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in class_model.score(docs).collect()}
    scores = [got[i].score for i, _ in zip(held, alike)]
    assert max(scores) == pytest.approx(min(scores))  # by hash they were dealt to different classes
    assert all(got[i].n_known == 4 for i, _ in zip(held, alike))
