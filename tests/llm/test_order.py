"""The registered language model looks at two words of context."""

from __future__ import annotations

import zlib

from lumberline.llm import queries as q
from tests.llm.test_corpus import SF_DIR, brute_scores


def test_op7_scores_with_two_words_of_context(spark):
    texts = {r["doc_id"]: r["text"] for r in q.table(spark, SF_DIR, "documents").collect()}
    want = brute_scores(texts, lambda i: zlib.crc32(str(i).encode()) % 7 == 2, 3)
    got = q.op7_language_model(spark, SF_DIR).collect()
    assert len(got) == len(texts)
    for row in got:
        n_tokens, *_, score = want[row["doc_id"]]
        assert abs(row["score"] - score) <= n_tokens * 3 * 16 / 255 / 2 + 1e-6
