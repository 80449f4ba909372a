import re

import __spark_entry__ as contract
import corpus_pipeline
from meridian.llm import registry


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in registry.QUERIES) == list(range(1, 14))
    assert {*registry.QUERIES, "pipeline"} <= set(contract.queries())


def test_pipeline_has_its_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "tokens"]
