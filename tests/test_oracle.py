"""Every query with SQL against that SQL; of the searches, which take many rounds, some of each kind."""

import pytest

from kerbline import catalog
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"  # for what has no rows on the small tables
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()
SEARCHES = {"islands", "largest_scc", "severance", "priority_slice", "shortest_path_cost", "stranded", "city_pockets", "route_option_costs", "walk_path_costs", "whatif_reach", "route_options"}
MANY_ROUNDS = ("graph_queries",)
OF_ROUTES = {"route_option_costs", "walk_path_costs", "whatif_reach", "project_sentences", "run_metadata", "trip_whatif", "detours", "route_options", "walk_within_budget"}


def _wanted(name: str) -> bool:
    slow = QUERIES[name].__module__.endswith(MANY_ROUNDS) or name in OF_ROUTES
    return name in SEARCHES or not slow


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES and _wanted(n)])
def test_same_rows_as_sql(spark, name):
    rows = compare(spark, FOLDER, QUERIES[name], ORACLES[name])
    assert rows or compare(spark, LARGER, QUERIES[name], ORACLES[name]), "no rows to compare"


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(QUERIES) - set(ORACLES) == {"loop_routes"}


def test_entry_points():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
