import os

import __spark_entry__ as entry
from workload.registry import REGISTRY

TINY = "/root/testdata/sf0.001"

# every operator of the inventory
OPERATORS = ([f"S{i}" for i in range(1, 16)] + [f"P{i}" for i in range(1, 13)] + [f"J{i}" for i in range(1, 9)]
             + [f"A{i}" for i in range(1, 15)] + [f"W{i}" for i in range(1, 7)] + [f"K{i}" for i in range(1, 5)]
             + ["U1", "U2"] + [f"E{i}" for i in range(1, 14)] + [f"F{i}" for i in range(1, 11)]
             + [f"L{i}" for i in range(1, 8)] + [f"N{i}" for i in range(1, 6)] + [f"T{i}" for i in range(1, 7)]
             + [f"Y{i}" for i in range(1, 5)] + ["R1", "R2", "R3"])


def test_every_operator_has_a_query():
    covered = {op for q in REGISTRY.values() for op in q.covers}
    assert covered == set(OPERATORS)


def test_contract():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)


def test_entry_runs(spark):
    if os.path.isdir(TINY):
        rows = entry.entry(spark).collect()
        assert rows and set(rows[0].asDict()) == {"page_type", "n_pages", "n_sites", "avg_confidence"}
