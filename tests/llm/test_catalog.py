"""Which queries of this folder SQL cannot state: their tests hold them against brute force."""
import __spark_entry__ as E
from riskgraph.llm import catalog

BRUTE_FORCE = {"op1_suffix", "op2_sharding", "op5_quality", "op6_jaccard", "op7_scoring", "op8_decontaminate", "op9_tokens",
               "op11_anchors", "op12_alignment"}


def test_every_query_has_an_oracle_or_is_known():
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == BRUTE_FORCE
    assert set(catalog.QUERIES) | {"pipeline"} <= set(E.queries())
    assert "pipeline" not in E.oracle_sql()
