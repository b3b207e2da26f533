"""How often values cross between Python and the JVM, and how often the pieces of a statement are put together."""

import re

from tidelog import scan_queries, source_queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_updates_are_analysed_in_one_pass(spark):
    assert len(re.findall(r"\bArrowEvalPython\b", plan(source_queries.analyze_many(spark, SF)))) == 1


def test_pieces_of_statements_are_put_together_once(spark):
    made = plan(scan_queries.modify_columns_forward(spark, SF).select("forward", "inverse"))
    assert made.count("zip_with(") == 2
