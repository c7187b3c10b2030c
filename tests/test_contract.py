import pytest

import __spark_entry__ as contract
from checks.compare import compare, connect

SF = "/root/testdata/sf0.001"


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_query_of_the_scanner_has_an_oracle():
    from checks.oracle import ORACLES
    from checks.spark_queries import QUERIES

    assert set(ORACLES) == set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize(
    "name",
    [
        "secret_counts_by_lang", "redacted_documents", "function_table_exact", "scan_issues", "env_upsert",
        "inserted_decorators", "pair_rules", "diff_sarif", "review_comments", "findings_markdown",
    ],
)
def test_query_equals_its_oracle(spark, name):
    con = connect(SF)
    assert compare(spark, con, SF, name, contract.queries()[name], contract.oracle_sql()[name]).startswith("ok")
