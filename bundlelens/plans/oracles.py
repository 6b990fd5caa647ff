"""SQL for a second engine (DuckDB), one text per registered query.

Each text stands alone over the order tables. It spells out the household view, then the query. Counts
are BIGINT and ratios DOUBLE; money is summed in whole cents, so digits do not depend on the order of
addition; rounding is half away from zero by floor, as in ``functions.numeric.rnd``.
"""

from bundlelens import schema as S
from bundlelens.operators import agents, preparation as prep
from bundlelens.operators.campaigns import LIST_COLUMNS
from bundlelens.plans import registry as R

# The household view (FIXTURES.md section 3), with tier, region, quarter, year and target.
_VIEW = """
select household_id,snapshot_date,state,age_of_primary,home_ownership,household_size,income_band,agency_channel,anchor_product,policy_tier,tenure_months,outreach_contacts_12m,claims_24m,digital_engagement_score,property_quote_started,annual_premium_anchor,projected_mphh_cltv,
 cast(ps as double)/cast(10 as double) propensity_score,
 cast(case when (ok*7919+ck*104729)%1000<ps then 1 else 0 end as int) converted_mphh,
 case agency_channel when 'Independent Agent' then 'IA-' when 'Captive Agent' then 'CA-' when 'Call Center' then 'CC-' else 'DO-' end||lpad(cast(1+(ok*13+ck)%(case agency_channel when 'Independent Agent' then 8 when 'Captive Agent' then 4 when 'Call Center' then 6 else 3 end) as varchar(20)),4,'0') agent_id
 from (select *, least(990,greatest(10,cast(floor(cast(1000 as double)/(cast(1 as double)+exp(-lo))+cast(0.5 as double)) as bigint))) ps, cast(pc as double)/cast(100 as double) annual_premium_anchor, floor(cast((pc+100*case when home_ownership='Homeowner' then 900+(ok*17)%901 else 400+(ok*17)%501 end)*least(96,greatest(12,tenure_months+12+ok%48))*18 as double)/cast(1200 as double))/cast(100 as double) projected_mphh_cltv from (select *, cast(case policy_tier when 'Basic' then 68 when 'Standard' then 92 when 'Plus' then 125 else 175 end*(850+(ok*31)%351) as bigint) pc,
 {LO} lo from (
select 'HH-'||lpad(cast(o_orderkey as varchar(20)),greatest(7,length(cast(o_orderkey as varchar(20))))::int,'0') household_id,
 cast(date '2023-01-01' + cast(date_diff('day', date '1995-01-01', cast(o_orderdate as date)) % 1095 as int) as date) snapshot_date,
 case c_nationkey%10 when 0 then 'OH' when 1 then 'TX' when 2 then 'FL' when 3 then 'CA' when 4 then 'PA' when 5 then 'IL' when 6 then 'GA' when 7 then 'NC' when 8 then 'MI' else 'AZ' end state,
 cast(22+o_custkey%56 as int) age_of_primary,
 case when c_acctbal>=4300 then 'Homeowner' when c_acctbal>=3300 then 'Condo' else 'Renter' end home_ownership,
 cast(1+o_custkey%5 as int) household_size,
 case (o_custkey%11)%5 when 0 then '<$50k' when 1 then '$50k-$75k' when 2 then '$75k-$100k' when 3 then '$100k-$150k' else '$150k+' end income_band,
 case c_mktsegment when 'AUTOMOBILE' then 'Captive Agent' when 'MACHINERY' then 'Call Center' when 'FURNITURE' then 'Direct Online' else 'Independent Agent' end agency_channel,
 case substr(o_orderpriority,1,1) when '3' then 'Motorcycle' when '4' then 'Boat' when '5' then 'Commercial Auto' else 'Auto' end anchor_product,
 case when o_totalprice<125000 then 'Basic' when o_totalprice<275000 then 'Standard' when o_totalprice<400000 then 'Plus' else 'Elite' end policy_tier,
 cast(1+(o_orderkey*7+o_custkey)%120 as int) tenure_months,
 cast(least(coalesce(n_lines,0),5) as int) outreach_contacts_12m,
 cast(least(coalesce(n_ret,0),3) as int) claims_24m,
 cast(1+(o_orderkey*3+o_custkey)%10 as int) digital_engagement_score,
 cast(case when (o_orderkey*11+o_custkey)%25<7 then 1 else 0 end as int) property_quote_started,
 o_orderkey ok, o_custkey ck
from orders join customer on o_custkey=c_custkey left join (select l_orderkey as k, count(*) as n_lines, sum(case when l_returnflag='R' then 1 else 0 end) as n_ret from lineitem group by l_orderkey) li on k=o_orderkey
) b) s) s3
"""


def _log_odds(intercept: float) -> str:
    """Scorecard of the view: the same weights in the same order as the scorecard table."""
    terms = "".join(f"+cast({w} as double)*(case when {rule} then 1 else 0 end)" for w, rule in prep.SCORECARD)
    return f"cast({intercept} as double){terms}"


def _case(column: str, mapping: dict, otherwise: str = "null") -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}::double" if isinstance(v, float) else str(v)
    return f"case {column} " + " ".join(f"when '{k}' then {lit(v)}" for k, v in mapping.items()) + f" else {otherwise} end"


_TIER = "case when propensity_score>=65 then 'High Propensity' when propensity_score>=40 then 'Medium Propensity' else 'Low Propensity' end"
_FACT = f"""v as ({_VIEW.replace('{LO}', _log_odds(-3.05))}),
h as (select *, {_TIER} propensity_tier, {_case('state', S.STATE_REGION, "'Other'")} region,
 year(snapshot_date)||'Q'||quarter(snapshot_date) as quarter, year(snapshot_date)::varchar as year from v),
b as (select *, {_case('quarter', S.QUARTER_TARGETS)} robinson_target_pct from h)"""


def _q(select: str, *ctes: str) -> str:
    return f"with {', '.join([_FACT, *ctes])} {select}"


# ---- the arithmetic of functions.numeric -------------------------------------------------

def r(x: str, k: int = 2) -> str:
    size = f"floor(abs({x})*{10 ** k}::double+0.5::double)/{10 ** k}::double"
    return f"(case when ({x})<0 then 0::double-{size} else {size} end)"


def ratio(a: str, b: str) -> str:
    return f"(({a})::double/nullif(({b})::double,0))"


def raw_pct(a: str, b: str) -> str:
    return f"((({a})::double*100::double)/nullif(({b})::double,0))"


def pct(a: str, b: str, k: int = 2) -> str:
    return r(raw_pct(a, b), k)


def units(c: str, scale: int) -> str:
    return f"sum(floor(({c})*{scale}::double+0.5::double)::bigint)"


def msum(c: str) -> str:
    return f"({units(c, 100)}::double/100::double)"


def mavg(c: str) -> str:
    return ratio(msum(c), f"count({c})")


def savg(c: str) -> str:
    return ratio(f"({units(c, 10)}::double/10::double)", f"count({c})")


def iavg(c: str) -> str:
    return ratio(f"sum({c})", f"count({c})")


N = "count(*)"
HITS = "sum(converted_mphh)::bigint"
OPEN = "sum(case when converted_mphh=0 then 1 else 0 end)::bigint"
CLTV, PREM = "projected_mphh_cltv", "annual_premium_anchor"
OPEN_CLTV = "case when converted_mphh=0 then projected_mphh_cltv end"
DIG, CON = "digital_engagement_score", "outreach_contacts_12m"
RATE = ratio(HITS, N)


def vol(rate: str = "conversion_rate_pct", n: str = "total_households", c: str = "converted") -> str:
    return f"{N} {n}, {HITS} {c}, {pct(HITS, N)} {rate}"


def _bucket(labels: list[str], cut: bool) -> str:
    edges = S.TENURE_EDGES[1:-1]
    whens = " ".join(f"when tenure_months<{e} then '{t}'" for e, t in zip(edges, labels))
    if not cut:
        return f"case {whens} else '{labels[-1]}' end"
    return f"case when tenure_months<0 or tenure_months>=121 or tenure_months is null then null {whens} else '{labels[-1]}' end"


def _in(column: str, values) -> str:
    return f"{column} in ({', '.join(repr(v) for v in values)})"


_X, _Y = R.CROSSSELL_CHOICE, R.BENCHMARK_CHOICE
_CROSS = " and ".join([_in("agency_channel", _X["channels"]), _in("anchor_product", _X["products"]), _in("policy_tier", _X["tiers"]),
                       _in("home_ownership", _X["ownership"]), f"tenure_months between {_X['tenure'][0]} and {_X['tenure'][1]}"])
_BENCH = " and ".join([_in("agency_channel", _Y["channels"]), _in("region", _Y["regions"]), _in("state", _Y["states"]),
                       _in("year", _Y["years"]), _in("policy_tier", _Y["tiers"])])
_HASH = "('0x'||substr(md5({}),1,8))::bigint"
_KEY = _HASH.format("household_id")
_SPINE = "spine(quarter, target_pct) as (values " + ", ".join(f"('{q}', {t}::double)" for q, t in S.QUARTER_TARGETS.items()) + ")"
_RATES = f"{RATE} rate, {N} households, {HITS} converted, {RATE}*100::double rate_pct"


def _filled(columns: list[str], table: str, flag: str) -> str:
    return " union all ".join(f"select '{c}' column_name, {flag_of} {flag}, count({c}) filled_rows from {table}"
                              for c, flag_of in ((c, "true" if flag == "present" else str(c not in S.NOT_FEATURES and c != S.TARGET).lower())
                                                 for c in columns))


def _summary(key: str) -> str:
    return _q(f"select {key}, {_RATES} from h group by {key}")


def _tenure(labels: list[str], measures: str) -> str:
    return _q(f"select tenure_bucket, {measures} from (select *, {_bucket(labels, True)} tenure_bucket from h) where tenure_bucket is not null group by tenure_bucket")


# ---- pieces shared by several queries ----------------------------------------------------

_INDEX = lambda by: r(ratio(raw_pct("converted", "total_households"), f"first_value({ratio('converted', 'total_households')}) over (order by {by} rows between unbounded preceding and unbounded following)"), 1)

# Quantile deciles by their definition: interpolated order statistics of -score, then edges below the value.
_DECILED = [
    "xs as (select -propensity_score x, row_number() over (order by -propensity_score)-1 i, count(*) over () n from h)",
    "ks as (select k, (n-1)*k//10 lo, ((n-1)*k%10)::double/10::double f from (select max(n) n from xs), range(0,11) t(k))",
    "es as (select distinct a.x+coalesce((b2.x-a.x)*f,0::double) e from ks join xs a on a.i=lo left join xs b2 on b2.i=lo+1)",
    "cs as (select score, greatest(1, sum(case when e < -score then 1 else 0 end))::bigint decile from (select distinct propensity_score score from h), es group by score)",
    "d as (select h.*, decile from h join cs on propensity_score=score)",
]

_QS = f"""qs as (select quarter, count(*) total, {HITS} converted, {RATE} rate, {RATE}*100::double rate_pct, {mavg(CLTV)} avg_cltv,
 {msum(CLTV)} total_cltv, {mavg(PREM)} avg_premium from b group by quarter),
e01 as (select s.quarter, case when total is not null then s.target_pct end target_pct, total, converted, rate, rate_pct, avg_cltv, total_cltv, avg_premium,
 rate_pct-s.target_pct vs_target, case when rate_pct-s.target_pct>=0 then 'On Track' when rate_pct-s.target_pct<0 then 'Behind' end status
 from spine s left join qs on qs.quarter=s.quarter)"""
_E05 = """e05 as (select right(quarter,2) label, max(case when quarter like '2023%' then rate_pct end) rate_2023,
 max(case when quarter like '2024%' then rate_pct end) rate_2024, max(case when quarter like '2025%' then rate_pct end) rate_2025 from e01 group by 1)"""
_COHORT = f"""cells as (select quarter, tenure_bucket, {RATE}*100::double rate_pct from (select *, {_bucket(S.TENURE_MO, True)} tenure_bucket from b)
 where tenure_bucket is not null and {_in('quarter', S.QUARTERS)} group by quarter, tenure_bucket)"""
_LB = f"""lb as (select agent_id, agency_channel, region, state, {N} households, {HITS} converted, {RATE} rate, {mavg(CLTV)} avg_cltv, {msum(CLTV)} total_cltv,
 {iavg(CON)} avg_outreach, {iavg(DIG)} avg_digital, {r(RATE + '*100::double')} rate_pct, {r(msum(CLTV) + '/1000::double', 1)} total_cltv_k
 from b group by agent_id, agency_channel, region, state having count(*)>=50)"""
_E17 = f"""st as (select state, {N} total, {HITS} converted, {RATE} rate, {mavg(CLTV)} avg_cltv, {msum(CLTV)} total_cltv, {mavg(PREM)} avg_premium,
 {iavg(CON)} avg_outreach, {iavg(DIG)} avg_digital, {r(RATE + '*100::double')} rate_pct, {r(msum(CLTV) + '/1000000::double')} total_cltv_M from b group by state)"""
_ST_MEAN = "((sum(floor(rate_pct*100::double+0.5::double)::bigint) over ())::double/(count(*) over ())::double/100::double)"
_QUOTE = """qc as (select count(*) total_households, count(*) filter (property_quote_started=1) quote_started,
 count(*) filter (property_quote_started=1 and converted_mphh=1) converted_with_quote, count(*) filter (property_quote_started=1 and converted_mphh=0) abandoned,
 count(*) filter (property_quote_started=0 and converted_mphh=1) converted_no_quote,
 count(*) filter (property_quote_started=0 and converted_mphh=0) never_started_not_converted from b)"""
_TREND = lambda a, b: f"case when {a}>{b} then 'Improved' when {a}<{b} then 'Declined' else 'Flat' end"
_ORDER_GRAIN = ", ".join(agents.GRAIN)
_OPP = f"opp as (select {OPEN} open_households, coalesce({msum(OPEN_CLTV)},0) open_cltv, {mavg(CLTV)} avg_cltv from h)"


def _yoy(name: str, rates: str, tail: str) -> str:
    return _q(f"""select a.{name}, a.rate rate_2023, b4.rate rate_2024, c.rate rate_2025, {r('b4.rate-a.rate')} delta_23_24_pp,
 {r('c.rate-b4.rate')} delta_24_25_pp{tail}, {_TREND('c.rate', 'b4.rate')} direction_24_25
 from rt a join rt b4 on a.{name}=b4.{name} and a.y='2023' and b4.y='2024' left join rt c on c.{name}=a.{name} and c.y='2025' where a.y='2023'""", rates)


def oracle_sql() -> dict[str, str]:
    money_M = lambda c, k=2: r(f"{msum(c)}/1000000::double", k)
    avgs = f"{r(mavg(PREM))} avg_anchor_premium, {r(mavg(CLTV))} avg_mphh_cltv"
    cols = ", ".join(S.HOUSEHOLD_COLUMNS)
    dated = lambda names: ", ".join(f"strftime({c},'%Y-%m-%d') {c}" if c == "snapshot_date" else c for c in names)
    o: dict[str, str] = {}

    # preparation
    number = "substr(household_id,4)::bigint"
    bad_age, bad_date = f"{number}%{R.BAD_AGE_EVERY}=0", f"{number}%{R.BAD_DATE_EVERY}=0"
    o["scan_households"] = _q(f"""select {dated(S.HOUSEHOLD_COLUMNS)}, 'parquet' read_from from h
 union all select {dated(S.HOUSEHOLD_COLUMNS)}, 'csv' from h where not ({bad_age}) and not ({bad_date})""")
    o["scan_rejects"] = _q(f"""select household_id, case when {bad_age} then 'unknown' else age_of_primary::varchar end age_of_primary,
 case when {bad_date} then '2023-02-30' else strftime(snapshot_date,'%Y-%m-%d') end snapshot_date,
 case when {bad_age} and {bad_date} then 'snapshot_date,age_of_primary' when {bad_age} then 'age_of_primary' else 'snapshot_date' end bad_columns
 from h where {bad_age} or {bad_date}""")
    o["write_snapshot"] = _q(f"select quarter, {vol('rate_pct')}, {msum(CLTV)} total_cltv from b group by quarter")
    o["dataset_profile"] = _q(f"""select '{S.TARGET}' target_variable, count(*) n_rows, {r(ratio(HITS, 'count(converted_mphh)'), 4)} conversion_rate,
 '{cols.replace(', ', ',')}' as columns, '{','.join(S.LEAKAGE_COLUMNS)}' leakage_columns, '{','.join(S.FINANCIAL_COLUMNS)}' financial_columns from h""")
    o["schema_check"] = _q(_filled(S.BENCHMARK_COLUMNS, "b", "present"))
    o["quality_checks"] = _q(f"""select 'conversion_rate' check_name, {ratio(HITS, 'count(converted_mphh)')} as value, {RATE}>0.20 and {RATE}<0.35 passed from b
 union all select 'quarters', count(distinct quarter)::double, count(distinct quarter)=12 from b """ + " ".join(
        f"union all select 'nulls_{c}', count(*) filter ({c} is null)::double, count(*) filter ({c} is null)=0 from b" for c in S.BENCHMARK_COLUMNS))
    o["value_counts"] = _q("select quarter, count(*) households from b group by quarter")
    o["agents_per_channel"] = _q("""select agency_channel, count(distinct agent_id) agents from b group by agency_channel
 union all select 'All', count(distinct agent_id) from b""")
    o["add_region"] = _q("select state, region, region<>'Other' is_mapped, count(*) households from b group by state, region")
    o["add_target"] = _q("select quarter, robinson_target_pct, robinson_target_pct is not null is_mapped, count(*) households from b group by quarter, robinson_target_pct")
    o["add_quarter_year"] = _q("select quarter, year, count(*) households from b group by quarter, year")
    pools = {c: f"{p}-" for c, (p, _) in S.AGENT_POOLS.items()}
    o["assign_agents"] = _q(f"""select agency_channel, agent_id, count(*) households from (select agency_channel, {_case('agency_channel', pools)}||
 lpad(({_KEY}%({_case('agency_channel', {c: n for c, (_, n) in S.AGENT_POOLS.items()})})+1)::varchar,4,'0') agent_id from h) group by 1,2""")
    o["add_propensity_tier"] = _q("select propensity_tier, count(*) households, min(propensity_score) min_score, max(propensity_score) max_score from h group by 1")
    o["add_projected_cltv"] = _q(f"""select household_id, {r('x')} projected_mphh_cltv from (select household_id,
 (annual_premium_anchor+(case when home_ownership='Homeowner' then 1350 else 650 end)::double)
 *least(greatest((tenure_months+36)::double/12::double,1::double),8::double)*0.18::double x from h)""")
    o["scorecard"] = _q(f"""select household_id, least(990,greatest(10,floor(1000::double/(1::double+exp(-lo))+0.5::double)::bigint))::double/10::double propensity_score
 from (select *, {_log_odds(prep.SCORECARD_INTERCEPT)} lo from h)""")
    o["filter_domains"] = _q(" union all ".join(
        f"select '{c}' filter_column, row_number() over (order by {c})-1 as position, {c} as value from (select distinct {c} from b)" for c in prep.FILTER_COLUMNS)
        + " union all select 'tenure_months', 0, min(tenure_months)::varchar from b union all select 'tenure_months', 1, max(tenure_months)::varchar from b")

    # filters
    o["filter_crosssell"] = _q(f"select household_id, agency_channel, anchor_product, policy_tier, home_ownership, tenure_months from h where {_CROSS}")
    o["filter_benchmark"] = _q(f"select household_id, agency_channel, region, state, year, policy_tier from b where {_BENCH}")
    o["filtered_share"] = _q(f"select count(*) filter ({_CROSS}) filtered, count(*) total, {ratio(f'count(*) filter ({_CROSS})', N)} share from h")
    o["open_households"] = _q(f"select count(*) open_households, {msum(CLTV)} open_cltv from h where converted_mphh=0")
    o["warm_leads"] = _q("select household_id, agency_channel, propensity_score, projected_mphh_cltv from h where property_quote_started=1 and converted_mphh=0")
    for name, k in (("decile_band", 2), ("decile_band_1", 1), ("decile_band_3", 3), ("decile_band_10", 10)):
        o[name] = _q(f"select household_id, propensity_score, decile from d where decile<={k}", *_DECILED)
    o["leaderboard_channel"] = _q(f"select {_ORDER_GRAIN}, households, converted, rate_pct from lb where {_in('agency_channel', R.BOARD_CHANNELS)}", _LB)
    o["having_min_group"] = _q("select agency_channel, policy_tier, count(*) households from h group by 1,2 having count(*)>=500")

    # cross-sell
    audited = {"household_id": "null_household_id", "agency_channel": "null_agency_channel", "anchor_product": "null_anchor_product",
               "policy_tier": "null_policy_tier", "tenure_months": "null_tenure_months", PREM: "null_annual_premium", CLTV: "null_projected_cltv"}
    o["overview_quality"] = _q(f"""select {vol(c='total_converted')}, {', '.join(f'count(*)-count({c}) {n}' for c, n in audited.items())},
 min(tenure_months) min_tenure_months, max(tenure_months) max_tenure_months, {r(iavg('tenure_months'), 1)} avg_tenure_months, {r(mavg(PREM))} avg_annual_premium from h""")
    o["segment_distribution"] = _q(f"""select agency_channel, anchor_product, policy_tier, {vol(n='household_count', c='converted_count')},
 {pct(N, 'sum(count(*)) over ()')} pct_of_total from h group by 1,2,3 order by household_count desc, 1,2,3 limit 30""")
    o["channel_rate"] = _q(f"select agency_channel, {vol()}, {avgs}, rank() over (order by {RATE} desc) rank_by_rate from h group by 1")
    o["tier_rate"] = _q(f"""select policy_tier, {vol()}, {r(mavg(PREM))} avg_anchor_premium, {money_M(PREM, 3)} total_anchor_premium_M,
 {money_M(CLTV, 3)} total_mphh_cltv_M, rank() over (order by {RATE} desc) rank_by_rate from h group by 1""")
    o["segment_rank"] = _q("""select *, rank() over (order by conversion_rate_pct desc) rank_high, rank() over (order by conversion_rate_pct) rank_low
 from g order by conversion_rate_pct desc, agency_channel, policy_tier, anchor_product limit 20""",
        f"g as (select agency_channel, policy_tier, anchor_product, {vol(n='household_count')}, {r(mavg(CLTV))} avg_mphh_cltv from h group by 1,2,3 having count(*)>=500)")
    won = "case when converted_mphh=1 then projected_mphh_cltv end"
    o["channel_opportunity"] = _q(f"select *, {r(ratio('unrealized_cltv_M', 'realized_cltv_M+unrealized_cltv_M') + '*100::double', 1)} pct_unrealized from g",
        f"""g as (select agency_channel, count(*) total_households, {HITS} already_converted, {OPEN} not_yet_converted,
 coalesce({money_M(won)},0) realized_cltv_M, coalesce({money_M(OPEN_CLTV)},0) unrealized_cltv_M, {r(mavg(OPEN_CLTV))} avg_cltv_per_unconverted from h group by 1)""")
    o["ownership_opportunity"] = _q(f"""select home_ownership, count(*) total_households, {OPEN} unconverted, {r(mavg(OPEN_CLTV))} avg_cltv_unconverted,
 coalesce({money_M(OPEN_CLTV)},0) total_opportunity_M, {pct(HITS, N)} conversion_rate_pct from h group by 1""")
    o["tenure_rate"] = _q(f"select {_bucket(S.TENURE_SORTABLE, False)} tenure_bucket, {vol()}, {avgs} from h group by 1")
    o["outreach_index"] = _q(f"select *, {_INDEX(CON)} index_vs_zero_contact from g",
        f"g as (select {CON}, {vol()}, {r(iavg(DIG))} avg_digital_score, {r(mavg(CLTV))} avg_mphh_cltv from h group by 1)")
    o["quote_outcome"] = _q(f"""select property_quote_started, converted_mphh, count(*) household_count, {avgs}, {r(iavg(DIG))} avg_digital_score,
 {r(iavg(CON))} avg_outreach_contacts, {pct(N, 'sum(count(*)) over ()')} pct_of_total from h group by 1,2""")
    o["score_deciles"] = _q(f"""select propensity_decile, households, converted, conversion_rate_pct, avg_score, total_cltv_M,
 {r(ratio('conversion_rate_pct', raw_pct('sum(converted) over ()', 'sum(households) over ()')))} lift_vs_random,
 {pct('sum(converted) over (order by propensity_decile rows between unbounded preceding and current row)', 'sum(converted) over ()')} cumulative_gain_pct from g""",
        "t as (select *, ntile(10) over (order by propensity_score desc, md5(household_id), household_id) propensity_decile from h)",
        f"""g as (select propensity_decile, {vol(n='households')}, {r(savg('propensity_score'), 1)} avg_score, {money_M(CLTV)} total_cltv_M from t group by 1)""")
    o["campaign_list"] = _q(f"""select {dated(LIST_COLUMNS)}, intervention_segment, rank_within_channel from (select *,
 case when property_quote_started=1 and converted_mphh=0 then 'Warm Lead: Quote Abandoned'
  when propensity_score>=65 and {CON}=0 then 'Warm Lead: High Score, No Outreach' when propensity_score>=50 and {CON} between 1 and 3 then 'Active Nurture'
  when home_ownership='Homeowner' and propensity_score>=55 then 'Property Target: Homeowner' else 'Standard Pipeline' end intervention_segment,
 row_number() over (partition by agency_channel order by propensity_score desc, projected_mphh_cltv desc, household_id) rank_within_channel
 from h where converted_mphh=0 and propensity_score>=40 and claims_24m<=1) where rank_within_channel<=500""")

    # benchmark
    raw = raw_pct(HITS, N)
    o["quarter_vs_target"] = _q(f"""select quarter, {vol('actual_rate_pct')}, min(robinson_target_pct) target_pct, {r(f'{raw}-min(robinson_target_pct)')} vs_target_pp,
 case when {raw}>=min(robinson_target_pct) then 'On Track' else 'Behind' end status, {r(mavg(CLTV))} avg_cltv, {money_M(CLTV)} total_cltv_M,
 {r(mavg(PREM))} avg_premium from b group by quarter""")
    o["target_gap_summary"] = _q(f"""select count(*) total_quarters, count(*) filter (rate<target) quarters_behind, count(*) filter (rate>=target) quarters_on_track,
 {r(ratio('sum(gap)', 'count(target)') + '/100::double')} avg_gap_pp, min(gap)::double/100::double worst_gap_pp, max(gap)::double/100::double best_gap_pp
 from (select *, floor((rate-target)*100::double+0.5::double)::bigint gap from p)""",
        f"p as (select quarter, {pct(HITS, N)} rate, min(robinson_target_pct) target from b group by quarter)")
    o["channel_contribution"] = _q(f"""select quarter, agency_channel, {vol('channel_rate_pct')},
 {pct(HITS, 'sum(sum(converted_mphh)) over (partition by quarter)', 1)} pct_of_quarter_conversions from b group by 1,2""")
    o["yoy_quarter"] = _yoy("quarter_label", f"rt as (select right(quarter,2) quarter_label, left(quarter,4) y, {pct(HITS, N)} rate from b group by 1,2)",
                            f", {_TREND('b4.rate', 'a.rate')} direction_23_24")
    o["yoy_channel"] = _yoy("agency_channel", f"rt as (select agency_channel, left(quarter,4) y, {pct(HITS, N)} rate from b group by 1,2)", "")
    o["yoy_years"] = _q(f"""select a.agency_channel, a.rate rate_2024, c.rate rate_2025, {r('c.rate-a.rate')} delta_24_25_pp, {_TREND('c.rate', 'a.rate')} direction_24_25
 from rt a join rt c on a.agency_channel=c.agency_channel and a.y='2024' and c.y='2025'""",
        f"rt as (select agency_channel, left(quarter,4) y, {pct(HITS, N)} rate from b group by 1,2)")
    o["yoy_cltv"] = _q(f"""select case when left(quarter,4) in ('2023','2024','2025') then left(quarter,4) end as year, count(*) total_households,
 {r(mavg(PREM))} avg_anchor_premium, {r(mavg(CLTV))} avg_cltv, {money_M(CLTV)} total_cltv_M from b group by 1""")
    o["cohort_tenure"] = _q(f"select quarter acquisition_quarter, {_bucket(S.TENURE_MO, False)} tenure_bucket, {vol()} from b group by 1,2")
    o["tenure_pooled_rank"] = _q(f"select {_bucket(S.TENURE_MO, False)} tenure_bucket, {vol('avg_conversion_rate_pct')}, rank() over (order by {RATE} desc) rank_by_rate from b group by 1")
    o["long_tenure_trend"] = _q(f"select quarter acquisition_quarter, {vol(n='households_60plus_months')} from b where tenure_months>=60 group by 1")
    o["cohort_groups_pooled"] = _q(f"""select {_bucket(S.TENURE_MO, False)} tenure_bucket, {_case('quarter', S.COHORT_GROUPS)} cohort_group, {vol()}
 from b where {_in('quarter', S.COHORT_GROUPS)} group by 1,2""")
    o["agent_leaderboard_sql"] = _q("""select *, rank() over (order by rate_pct desc) rank_by_rate, rank() over (order by converted desc) rank_by_conversions,
 rank() over (order by total_cltv_k desc) rank_by_cltv from g""",
        f"""g as (select agent_id, agency_channel, region, state, {N} households, {HITS} converted, {pct(HITS, N)} rate_pct, {r(mavg(CLTV))} avg_cltv,
 {r(msum(CLTV) + '/1000::double', 1)} total_cltv_k, {r(iavg(CON))} avg_outreach, {r(iavg(DIG))} avg_digital_score from b group by 1,2,3,4 having count(*)>=50)""")
    first = lambda order: f"(select sum(floor(rate_pct*100::double+0.5::double)::bigint)::double/count(*)::double/100::double from (select * from {{}} order by {order} limit 10))"
    top, bottom = first("rate_pct desc, agent_id").format("ar"), first("rate_pct, agent_id").format("ar")
    o["agent_gap_sql"] = _q(f"""select {r(top)} top_10_avg_rate, {r('quantile_cont(rate_pct,0.5)')} median_rate, {r(bottom)} bottom_10_avg_rate,
 {r(f'{top}-{bottom}')} top_bottom_gap_pp from ar""", f"ar as (select agent_id, {pct(HITS, N)} rate_pct from b group by 1 having count(*)>=50)")
    mean_of = lambda c, s: f"({units(c, s)}::double/count(*)::double/{s}::double)"
    o["region_agents_sql"] = _q(f"""select region, count(*) agent_count, {r(mean_of('rate_pct', 100))} avg_rate_pct, min(rate_pct) min_rate_pct, max(rate_pct) max_rate_pct,
 {r('max(rate_pct)-min(rate_pct)')} rate_spread_pp, {r(mean_of('total_cltv_k', 10), 1)} avg_cltv_k from ra group by 1""",
        f"ra as (select agent_id, region, {pct(HITS, N)} rate_pct, {r(msum(CLTV) + '/1000::double', 1)} total_cltv_k from b group by 1,2 having count(*)>=50)")
    o["state_vs_portfolio"] = _q(f"""select state, {vol('rate_pct')}, {OPEN} unconverted, {r(f'{raw}-any_value(p)')} vs_portfolio_avg_pp,
 case when {raw}>=any_value(p) then 'Above Avg' else 'Below Avg' end vs_avg_status, {r(mavg(PREM))} avg_anchor_premium, {r(mavg(CLTV))} avg_cltv,
 {money_M(CLTV)} total_cltv_M, {r(iavg(CON))} avg_outreach_contacts, {r(iavg(DIG))} avg_digital_score from b, (select {pct(HITS, N)} p from b) group by state""")
    o["state_channel_rank"] = _q(f"select state, agency_channel, {vol()}, rank() over (partition by state order by {RATE} desc) rank_within_state from b group by 1,2")
    o["quote_funnel"] = _q(f"""select *, {pct('quote_started', 'total_households')} quote_start_rate_pct, {pct('converted_with_quote', 'quote_started')} quote_conversion_rate_pct,
 {pct('abandoned', 'quote_started')} abandonment_rate_pct, {r(ratio(ratio('converted_with_quote', 'quote_started'), ratio('converted_no_quote', 'total_households-quote_started')))} quote_starter_lift_vs_non_starter from qc""", _QUOTE)
    band = "case when contacts between 1 and 3 then 'Sweet Spot' when contacts>3 then 'Diminishing Returns' else 'No Outreach' end outreach_band"
    o["outreach_bands"] = _q(f"select *, {_INDEX('contacts')} index_vs_zero_contact, {band} from g",
        f"g as (select {CON} contacts, {vol()}, {r(iavg(DIG))} avg_digital_score, {r(mavg(CLTV))} avg_cltv from b group by 1)")
    o["tier_outreach_sql"] = _q(f"select propensity_tier, {CON} contacts, {vol()} from b group by 1,2")
    o["leading_indicators_sql"] = _q(f"""select quarter, count(*) total_households, {r(iavg(DIG))} avg_digital_score, {r(savg('propensity_score'))} avg_propensity_score,
 {r(iavg(CON))} avg_outreach_contacts, {pct(HITS, N)} actual_conversion_rate_pct, min(robinson_target_pct) robinson_target_pct from b group by quarter""")

    # cross-sell dashboard
    kept = lambda c: f"case when {_CROSS} then {c} end"
    fn, fw = f"count(*) filter ({_CROSS})", f"count(*) filter ({_CROSS} and converted_mphh=1)"
    o["kpi_crosssell"] = _q(f"""select {fn} households, coalesce({ratio(fw, fn)},0) rate, coalesce({ratio(fw, fn)},0)-{RATE} rate_vs_total, {ratio(fn, N)} share_of_total,
 {mavg(kept(CLTV))} avg_cltv, {mavg(kept(PREM))} avg_premium, coalesce({msum(f'case when {_CROSS} and converted_mphh=0 then {CLTV} end')},0) open_cltv, {fn}-{fw} open_households from h""")
    o["tenure_spark"] = _tenure(S.TENURE_PLAIN, f"{RATE}*100::double rate_pct")
    o["conversion_composition"] = _q(f"""select 'Converted' outcome, {HITS} households, {raw_pct(HITS, N)} share_pct from h
 union all select 'Single-Product Household', {OPEN}, {raw_pct(OPEN, N)} from h""")
    o["channel_summary"], o["tier_summary"] = _summary("agency_channel"), _summary("policy_tier")
    o["outreach_summary"] = _q(f"select {CON} contacts, {_RATES}, {CON}<=3 within_useful from h group by {CON}")
    o["tenure_summary"] = _tenure(S.TENURE_MO_SPACED, _RATES)
    o["priority_matrix"] = _q(f"""select agency_channel, policy_tier, count(*) households, {RATE} rate, {RATE}*100::double rate_pct, {mavg(CLTV)} avg_cltv,
 policy_tier||' / '||split_part(agency_channel,' ',1) as label from h group by 1,2""")
    o["channel_rate_value"] = _q(f"select agency_channel, {RATE} rate, {mavg(CLTV)} avg_cltv from h group by 1")
    o["tenure_value"] = _tenure(S.TENURE_MO_SPACED, f"{RATE} rate, {msum(CLTV)} total_cltv, {msum(CLTV)}/1000000::double total_cltv_M")
    o["ownership_open_share"] = _q(f"""select home_ownership, cents::double/100::double open_cltv, {raw_pct('cents', 'sum(cents) over ()')} share_pct
 from (select home_ownership, {units(CLTV, 100)} cents from h where converted_mphh=0 group by 1)""")
    o["ownership_avg"] = _q(f"select home_ownership, {mavg(CLTV)} avg_cltv from h group by 1")
    o["lift_table"] = _q(f"""select decile, households, converted, {ratio('converted', 'households')} rate,
 {ratio(ratio('converted', 'households'), ratio('sum(converted) over ()', 'sum(households) over ()'))} lift,
 (sum(converted) over (order by decile))::bigint cum_converted, {ratio('sum(converted) over (order by decile)', 'sum(converted) over ()')}*100::double cum_gain_pct from g""",
        *_DECILED, f"g as (select decile, count(*) households, {HITS} converted from d group by 1)")
    o["decile_profile"] = _q(f"""select max_decile, count(*) households, {mavg(CLTV)} avg_cltv, floor(quantile_cont(tenure_months,0.5))::bigint median_tenure_months,
 (select agency_channel from d d2 where d2.decile<=max_decile group by 1 order by count(*) desc, 1 limit 1) top_channel
 from (values (1),(2),(3),(10)) bands(max_decile), d where decile<=max_decile group by max_decile""", *_DECILED)
    o["opportunity_summary"] = _q("select * from opp", _OPP)
    saved = "floor(open_households::double*0.15::double)"
    gross, cost = f"{saved}*avg_cltv", "open_households::double*35::double"
    o["campaign_case"] = _q(f"""select open_households, {saved}::bigint saved_households, {gross} gross_revenue, {cost} total_cost, {gross}-{cost} net_revenue,
 coalesce({ratio(gross, cost)},0) roi from opp""", _OPP)
    o["campaign_grid"] = _q("""select save_rate_pct, unit_cost, (open_households::double*(save_rate_pct::double/100::double)*avg_cltv-open_households::double*unit_cost)/1000000::double net_revenue_M,
 case when save_rate_pct=15 then 'selected' when save_rate_pct<15 then 'below' else 'above' end scenario
 from opp, (values (5),(10),(15),(20),(25),(30)) s(save_rate_pct), (values (35::double),(80::double)) c(unit_cost)""", _OPP)

    # propensity model
    o["encode_features"] = _q(f"select household_id, {', '.join(S.NUMERIC_FEATURES)}, "
                              + ", ".join(f"{_case(c, codes)} {c}_enc" for c, codes in S.ORDINAL_CODES.items()) + " from h")
    spot = _HASH.format("'42-'||converted_mphh||'-'||household_id")
    o["stratified_split"] = _q(f"select household_id, converted_mphh, case when {spot}<{int(0.2 * 2**32)} then 'test' else 'train' end split from h")
    tn, fp, fn_, tp = (f"count(*) filter (propensity_score{'>=' if p else '<'}50 and converted_mphh={a})" for p, a in ((0, 0), (1, 0), (0, 1), (1, 1)))
    o["confusion"] = _q(f"""select {tn} tn, {fp} fp, {fn_} fn, {tp} tp, coalesce({ratio(f'{tn}+{tp}', N)},0) accuracy,
 coalesce({ratio(tp, f'{tp}+{fp}')},0) as precision, coalesce({ratio(tp, f'{tp}+{fn_}')},0) recall from h""")
    o["quantile_deciles"] = _q("select decile, count(*) households, min(propensity_score) min_score, max(propensity_score) max_score from d group by 1", *_DECILED)
    lowest = _HASH.format("'train-42-'||converted_mphh||'-'||household_id")
    train = f"train as (select *, count(*) over () n from h where {spot}>={int(0.2 * 2**32)})"
    most = float(R.MAX_TRAIN_ROWS)
    share = f"floor({max(1.0, most - 4.0 * most ** 0.5)!r}::double/n::double*4294967296::double)::bigint"
    o["train_gbt"] = _q(f"""select count(*) training_rows, {HITS} training_converted, 80::int trees, 4::int depth, {len(S.FEATURES)}::int features
 from train where n<={R.MAX_TRAIN_ROWS} or {lowest}<{share}""", train)
    o["score_households"] = _q(f"""select household_id, agency_channel, tenure_months, projected_mphh_cltv, converted_mphh,
 case when {spot}<{int(0.2 * 2**32)} then 'test' else 'train' end split, quarter, true is_probability, true class_follows from b""")
    o["model_auc"] = _q(f"""select (select count(*) from h) households, (select {HITS} from h) converted,
 sum(p*(2*(coalesce(sum_q,0))+q))::double/(2::double*sum(p)::double*sum(q)::double) auc
 from (select p, q, sum(q) over (order by propensity_score rows between unbounded preceding and 1 preceding) sum_q from
  (select propensity_score, {HITS} p, count(*) filter (converted_mphh=0) q from h group by 1))""")
    o["feature_importance"] = "select * from (values " + ", ".join(
        f"('{f}', '{S.FEATURE_LABELS[f]}', true, true, {len(S.FEATURES)}::bigint)" for f in S.FEATURES) + ") t(feature, label, is_share, sum_is_one, features)"
    o["leakage_guard"] = _q(_filled(S.HOUSEHOLD_COLUMNS, "h", "allowed"))

    # benchmark dashboard
    o["quarter_summary"] = _q("select * from e01", _SPINE, _QS)
    q_rate = lambda q: f"coalesce({raw_pct_of(q)},0)"
    raw_pct_of = lambda q: f"{ratio(f'''count(*) filter (quarter='{q}' and converted_mphh=1)''', f'''count(*) filter (quarter='{q}')''')}*100::double"
    bn, bw = f"count(*) filter ({_BENCH})", f"count(*) filter ({_BENCH} and converted_mphh=1)"
    o["kpi_benchmark"] = _q(f"""select '2025Q4' current_quarter, {q_rate('2025Q4')} current_rate_pct, {q_rate('2025Q3')} previous_rate_pct, 30.5::double current_target_pct,
 {q_rate('2025Q4')}-30.5::double vs_target, {bn} filtered_households, {bw} filtered_converted, coalesce({ratio(bw, bn)}*100::double,0) filtered_rate_pct,
 coalesce({msum(f'case when {_BENCH} and converted_mphh=0 then {CLTV} end')},0) open_cltv, {q_rate('2025Q4')}-{q_rate('2024Q4')} yoy_delta from b""")
    o["tracker_status"] = _q("""select count(*) filter (status='Behind') quarters_behind, count(*) filter (status='On Track') quarters_on_track, count(rate_pct) quarters_tracked,
 max(quarter) filter (rate_pct is not null) latest_quarter, arg_max(rate_pct, quarter) latest_rate_pct, arg_max(target_pct, quarter) filter (rate_pct is not null) latest_target_pct,
 arg_max(vs_target, quarter) filter (rate_pct is not null) latest_gap from e01""", _SPINE, _QS)
    o["channel_quarter_grid"] = _q("""select s.quarter, c.agency_channel, coalesce(converted,0)::bigint converted from spine s cross join (select distinct agency_channel from b) c
 left join (select quarter, agency_channel, sum(converted_mphh) converted from b group by 1,2) g on g.quarter=s.quarter and g.agency_channel=c.agency_channel""", _SPINE)
    o["yoy_table"] = _q("select *, rate_2024-rate_2023 delta_23_24, rate_2025-rate_2024 delta_24_25 from e05", _SPINE, _QS, _E05)
    pair = lambda label, d: f"select '{label}' as years, {r(f'coalesce(avg({d}),0)', 6)} avg_delta_pp, count({d}) quarters_compared, count(*) filter ({d}>0) quarters_improved from e05"
    o["yoy_summary"] = _q(pair("2023-2024", "rate_2024-rate_2023") + " union all " + pair("2024-2025", "rate_2025-rate_2024"), _SPINE, _QS, _E05)
    in_year = lambda y: ratio(f"sum(case when year='{y}' then converted_mphh end)", f"count(*) filter (year='{y}')") + f"*100::double rate_{y}"
    o["channel_year_pivot"] = _q("""select *, rate_2024-rate_2023 delta_23_24, rate_2025-rate_2024 delta_24_25, case when max(rate_2025) over () is not null then rate_2025-rate_2024 when max(rate_2024) over () is not null then rate_2024-rate_2023 end sort_delta from g""",
        f"g as (select agency_channel, {', '.join(in_year(y) for y in S.YEARS)} from b group by 1)")
    o["cltv_year"] = _q(f"select year, {mavg(CLTV)} avg_cltv, {msum(CLTV)} total_cltv, {msum(CLTV)}/1000000::double total_cltv_M from b group by 1")
    o["tenure_mean_of_quarters"] = _q(f"select *, avg_rate_pct=max(avg_rate_pct) over () is_best from (select tenure_bucket, {r('avg(rate_pct)', 6)} avg_rate_pct from cells group by 1)", _COHORT)
    o["cohort_matrix"] = _q("select s.quarter, " + ", ".join(f"max(case when tenure_bucket='{t}' then rate_pct end) \"{t}\"" for t in S.TENURE_MO)
                            + " from spine s left join cells c on c.quarter=s.quarter group by 1", _SPINE, _COHORT)
    o["cohort_matrix_spine"] = _q("select s.quarter, " + ", ".join(f"max(case when tenure_bucket='{t}' then rate_pct end) \"{t}\"" for t in S.TENURE_MO)
                                  + f" from spine s left join cells c on c.quarter=s.quarter where {_in('s.quarter', R.OWN_SPINE)} group by 1", _SPINE, _COHORT)
    o["cohort_groups_mean"] = _q(f"select {_case('quarter', S.COHORT_GROUPS)} cohort, tenure_bucket, {r('avg(rate_pct)', 6)} rate_pct from cells where {_in('quarter', S.COHORT_GROUPS)} group by 1,2", _COHORT)
    o["agent_leaderboard"] = _q("""select *, rank() over (order by converted desc) rank_converted, rank() over (order by rate desc) rank_rate,
 rank() over (order by total_cltv desc) rank_cltv from lb""", _LB)
    boards = {"": "rate_pct", "_conversions": "converted", "_cltv": "total_cltv"}
    for mode, by in boards.items():
        o[f"leaderboard_top{mode}"] = _q(f"""select p as position, case p when 1 then '1st' when 2 then '2nd' when 3 then '3rd' else p||'th' end position_label, {_ORDER_GRAIN}, households, converted, rate_pct, total_cltv
 from (select *, row_number() over (order by {by} desc, {_ORDER_GRAIN}) p from lb) where p<=15""", _LB)
    o["agent_rate_spread"] = _q("select agency_channel, count(*) leaderboard_rows, " + ", ".join(
        f"{r(f'quantile_cont(rate_pct,{q})', 4)} {n}_rate_pct" for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")))
        + f", {r(mean_of('rate_pct', 100), 4)} mean_rate_pct from lb group by 1", _LB)
    o["region_agents"] = _q(f"select region, count(*) agents, {r(mean_of('rate_pct', 100), 6)} avg_rate_pct, {r(mean_of('total_cltv_k', 10), 6)} avg_cltv_k from lb group by 1", _LB)
    down = ", ".join(f"{c} desc" for c in agents.GRAIN)
    for mode, by in boards.items():
        o[f"agent_gap{mode}"] = _q(f"""select {r(first(f'{by} desc, {_ORDER_GRAIN}').format('lb'), 6)} top_avg_rate, {r('quantile_cont(rate_pct,0.5)', 4)} median_rate,
 {r(first(f'{by}, {down}').format('lb'), 6)} bottom_avg_rate from lb""", _LB)
    leader = lambda what, by: f"(select {what} from lb order by {by} desc, {_ORDER_GRAIN} limit 1)"
    o["top_agent"] = _q(f"""select count(*) leaderboard_rows, {leader('agent_id', 'converted')} top_agent_by_conversions, max(converted) top_converted,
 {leader('agent_id', 'rate_pct')} top_agent_by_rate, {leader('agency_channel', 'rate_pct')} top_rate_channel, max(rate_pct) top_rate_pct,
 max(rate_pct) filter (agency_channel='Independent Agent') top_independent_rate_pct from lb""", _LB)
    o["state_summary"] = _q(f"""select *, total-converted unconverted, rate_pct-{_ST_MEAN} vs_avg,
 case when rate_pct>={_ST_MEAN} then 'Above Avg' else 'Below Avg' end vs_avg_status from st""", _E17)
    ends = lambda what, order: f"(select {what} from st order by {order} limit 1)"
    best, worst = "rate_pct desc, state", "rate_pct, state desc"
    o["state_spread"] = _q(f"""select {ends('state', best)} top_state, {ends('rate_pct', best)} top_rate_pct, {ends('state', worst)} bottom_state, {ends('rate_pct', worst)} bottom_rate_pct,
 {r(f"{ends('rate_pct', best)}-{ends('rate_pct', worst)}")} spread_pp""", _E17)
    o["state_by_cltv"] = _q("select state, total_cltv_M from st", _E17)
    o["state_channel_matrix"] = _q("select state, " + ", ".join(f"max(case when agency_channel='{c}' then x end) \"{c}\"" for c in S.CHANNELS) + " from g group by 1",
        f"g as (select state, agency_channel, {r(RATE + '*100::double')} x from b group by 1,2)")
    rates3 = f"""coalesce({ratio('abandoned', 'quote_started')},0) abandon_rate, coalesce({ratio('converted_with_quote', 'quote_started')},0) quote_rate,
 {ratio(f"coalesce({ratio('converted_with_quote', 'quote_started')},0)", ratio('converted_with_quote+converted_no_quote', 'total_households'))} lift_vs_overall"""
    stages = (("All Households", "total_households"), ("Quote Started", "quote_started"), ("Converted (w/ Quote)", "converted_with_quote"))
    o["funnel_stages"] = _q(" union all ".join(f"select {i}::bigint stage_ord, '{s}' stage, {c} households, {ratio(c, 'total_households')}*100::double pct_of_all, {rates3} from qc"
                                               for i, (s, c) in enumerate(stages, 1)), _QUOTE)
    outcomes = (("Converted (started quote)", "converted_with_quote"), ("Abandoned (started, not converted)", "abandoned"),
                ("Converted (no quote)", "converted_no_quote"), ("Never started, not converted", "never_started_not_converted"))
    o["quote_outcomes"] = _q(" union all ".join(f"select '{s}' outcome, {c} households, {raw_pct(c, 'total_households')} share_pct from qc" for s, c in outcomes), _QUOTE)
    o["outreach_stats"] = _q(f"select *, {band} from (select {CON} contacts, {_RATES} from b group by 1)")
    o["tier_outreach"] = _q(f"""select propensity_tier, {CON} contacts, {RATE}*100::double rate_pct,
 case propensity_tier when 'High Propensity' then 1 when 'Medium Propensity' then 2 else 3 end::bigint tier_ord from b group by 1,2""")
    o["leading_indicators"] = _q(f"""select s.quarter, avg_digital, avg_propensity, avg_outreach from spine s left join (select quarter, {iavg(DIG)} avg_digital,
 {savg('propensity_score')} avg_propensity, {iavg(CON)} avg_outreach from b group by 1) g on g.quarter=s.quarter""", _SPINE)
    return o
