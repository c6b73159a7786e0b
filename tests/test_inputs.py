"""What several steps read is made once."""
from riskgraph.plans.scenarios import Inputs
from riskgraph.sources import fixtures

SF = "/root/testdata/sf0.001"


def test_invoices_arcs_and_seeds_are_written_once(spark):
    inp = Inputs(spark, SF)
    for made, anew in ((inp.documents(), fixtures.documents(spark, SF)), (inp.arcs(), fixtures.arcs(spark, SF))):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan, plan
        assert made.count() == anew.count() > 0
        assert made.exceptAll(anew).isEmpty()
    assert "Aggregate" not in inp.seeds()._jdf.queryExecution().executedPlan().toString()
    assert set(Inputs(spark, SF).arcs().inputFiles()) == set(inp.arcs().inputFiles())
