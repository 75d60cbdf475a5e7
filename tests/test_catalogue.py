"""Every registered query of the engine against its DuckDB SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from ledgerlark.plans import catalogue

from . import registry_cases

FOLDER = Path("/root/testdata/sf0.001")


def normal(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return ""
        return repr(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.mark.skipif(not FOLDER.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, name):
    got = catalogue.QUERIES[name](spark, str(FOLDER)).toPandas()
    if name in catalogue.ORACLE_SQL:
        db = duckdb.connect()
        for p in FOLDER.glob("*.parquet"):
            db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p / '*.parquet' if p.is_dir() else p}')")
        want = db.execute(catalogue.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and normal(got) == normal(want)


@pytest.mark.parametrize("name", registry_cases.QUERIES)
def test_registry_case(spark, name):
    got, want = registry_cases.QUERIES[name](spark, "").toPandas(), duckdb.sql(registry_cases.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and normal(got) == normal(want)


@pytest.mark.skipif(not FOLDER.exists(), reason="needs the driver's tables")
def test_candidates_are_counted_over_all_parts(spark):
    part = pd.read_parquet(FOLDER / "part.parquet")
    keys = {r.p_partkey: {r.p_brand.lower(), r.p_type.lower(), *r.p_name.lower().split(" ")} for r in part.itertuples()}
    want = {a: sum(a != b and bool(x & y) for b, y in keys.items()) for a, x in keys.items()}
    got = catalogue.QUERIES["multi_key_candidate_counts"](spark, str(FOLDER)).collect()
    assert len(got) == len(want) > 40 and {r["p_partkey"]: r["candidates"] for r in got} == want
