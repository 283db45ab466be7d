"""Whole texts are hashed only where another can be equal."""

from __future__ import annotations

import pytest

from lumberline.llm import exact_dedup
from tests.llm.test_corpus import documents


def test_only_texts_of_groups_are_hashed_again(spark):
    rows = [(1, "A b"), (2, "a b"), (3, "only"), (4, "one more")]
    kept = exact_dedup.drop_copies(documents(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" in plan and "touched" in plan


@pytest.mark.parametrize("small", [100_000, 0])
def test_hashes_do_not_depend_on_the_size(spark, small, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SMALL_ROWS", small)
    got = exact_dedup.exact_groups(documents(spark, [(1, "A b"), (2, "a b"), (3, "only")])).collect()
    assert {r["doc_id"]: r["text_sha256"] is None for r in got} == {1: False, 2: False, 3: True}
