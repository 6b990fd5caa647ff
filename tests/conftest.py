import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

from bundlelens import schema as S
from bundlelens.session import build_session

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                            spark__driver__host="127.0.0.1", spark__driver__bindAddress="127.0.0.1", spark__driver__memory="6g",
                            spark__sql__maxMetadataStringLength="10000",
                            spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Benchmark rows with defaults for every column not given."""
    default = dict(household_id="HH-0", snapshot_date=None, state="OH", age_of_primary=40, home_ownership="Renter", household_size=2,
                   income_band="<$50k", agency_channel="Call Center", anchor_product="Auto", policy_tier="Basic", tenure_months=10,
                   outreach_contacts_12m=1, claims_24m=0, digital_engagement_score=5, property_quote_started=0,
                   annual_premium_anchor=700.0, projected_mphh_cltv=1000.0, propensity_score=30.0,
                   propensity_tier="Low Propensity", converted_mphh=0, agent_id="CC-0001", region="Midwest", quarter="2023Q1",
                   robinson_target_pct=25.0)

    def build(rows):
        full = [tuple({**default, "household_id": f"HH-{i}", **row}[c] for c in S.BENCHMARK_COLUMNS) for i, row in enumerate(rows)]
        return spark.createDataFrame(full, S.BENCHMARK_SCHEMA)

    return build
