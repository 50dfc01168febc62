"""SQL twins of the operators' queries on the smallest tables, and the pipeline stage by stage."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from casework.llm import queries
from casework.sources.tables import TABLES
from scripts.check_oracle import digest
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = entry.queries()[name](spark, SF_SMALL)
    res = con.execute(queries.ORACLES[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(cols, res.fetchall())[0]


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


def test_pipeline_stages(spark):
    from tests.llm.test_dedup import brute_components
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    states = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, states[-1], SF_SMALL).cache()
        assert out.columns == docs.columns
        states.append(out)
    start, known, exact, near, mixed = ([tuple(r) for r in s.collect()] for s in states)
    assert len(known) == len(start)  # every document of the table has letters and a clear language
    best = {}
    for r in known:
        best[r[1]] = max(best.get(r[1], r[0]), r[0])
    assert sorted(r[0] for r in exact) == sorted(best.values())
    want = {c for i, n, c in brute_components(exact)}
    assert sorted(r[0] for r in near) == sorted(want)
    assert {r[0] for r in mixed} <= {r[0] for r in near} and set(mixed) <= set(near)
    times = {}
    for r in mixed:
        times[r[0]] = times.get(r[0], 0) + 1
    assert max(times.values()) <= 2
    packed = corpus_pipeline.STAGES[-1][1](spark, states[-1], SF_SMALL).collect()
    assert sum(r.piece == 0 for r in packed) == len(mixed)
