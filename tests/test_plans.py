"""Plan shape: column pruning reaches the parquet scans; slot ranking limits before the shuffle."""

import re

import __spark_entry__ as entry
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _read_schemas(plan: str) -> list[str]:
    return re.findall(r"ReadSchema: (struct<[^>]*>)", plan)


def test_case_table_prunes_columns_and_limits_slots(spark):
    plan = _plan(entry.queries()["case_table"](spark, SF_SMALL))
    schemas = " ".join(_read_schemas(plan))
    for unused in ("l_returnflag", "l_linestatus", "l_tax", "o_totalprice", "c_name", "p_name", "p_brand"):
        assert unused not in schemas, unused
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_forward_fill_reads_only_needed_columns(spark):
    plan = _plan(entry.queries()["forward_fill"](spark, SF_SMALL))
    for s in _read_schemas(plan):
        assert "props" not in s and "ts:" not in s


def test_profile_reads_only_profiled_columns(spark):
    plan = _plan(entry.queries()["column_profile"](spark, SF_SMALL))
    for s in _read_schemas(plan):
        assert "l_comment" not in s and "l_shipdate" not in s and "l_returnflag" not in s
