"""DuckDB oracle SQL for the registered queries.

Written from the analysis semantics, independently of the Spark code: the
customer mart, the engineered table, states and archetypes are common table
expressions that the per-query statements build on.
"""

from __future__ import annotations

MART = """
geo AS (SELECT n_nationkey, r_name AS region_category FROM nation JOIN region ON n_regionkey = r_regionkey),
po AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first_order, max(CAST(o_orderdate AS DATE)) AS last_order,
              avg(o_totalprice) AS avg_txn, count(DISTINCT CAST(o_orderdate AS DATE)) AS n_order_days
       FROM orders GROUP BY o_custkey),
pf AS (SELECT o_custkey, o_orderpriority AS feedback FROM (
         SELECT o_custkey, o_orderpriority,
                row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS rn
         FROM orders GROUP BY o_custkey, o_orderpriority) WHERE rn = 1),
ln AS (SELECT o_custkey, l_quantity, CAST(l_shipdate AS DATE) AS ship, l_returnflag
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
pl AS (SELECT o_custkey, avg(l_quantity) AS avg_qty, max(ship) AS last_ship FROM ln GROUP BY o_custkey),
pc AS (SELECT o_custkey, l_returnflag AS complaint_status FROM (
         SELECT o_custkey, l_returnflag,
                row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, l_returnflag) AS rn
         FROM ln GROUP BY o_custkey, l_returnflag) WHERE rn = 1),
pe AS (SELECT user_id, avg(value) AS event_value_avg FROM events GROUP BY user_id),
mart AS (
  SELECT c_custkey AS customer_id, region_category, c_mktsegment AS membership_category,
         c_acctbal AS points_in_wallet, first_order AS joining_date,
         coalesce(avg_txn, 0.0) AS avg_transaction_value, coalesce(avg_qty, 0.0) AS avg_time_spent,
         CASE WHEN n_order_days > 1 THEN CAST(date_diff('day', first_order, last_order) AS DOUBLE) / (n_order_days - 1) END
           AS avg_frequency_login_days,
         CAST(date_diff('day', last_ship, (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem)) AS DOUBLE)
           AS days_since_last_login,
         event_value_avg, complaint_status, feedback,
         CAST(CASE WHEN last_order IS NULL
                     OR date_diff('day', last_order, (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)) > 180
                   THEN 1 ELSE 0 END AS INTEGER) AS churn
  FROM customer
  LEFT JOIN geo ON c_nationkey = n_nationkey
  LEFT JOIN po ON c_custkey = po.o_custkey
  LEFT JOIN pf ON c_custkey = pf.o_custkey
  LEFT JOIN pl ON c_custkey = pl.o_custkey
  LEFT JOIN pc ON c_custkey = pc.o_custkey
  LEFT JOIN pe ON c_custkey = user_id)
"""

REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def _dummy(r: str) -> str:
    return "region_" + "".join(ch if ch.isalnum() or ch == "_" else "_" for ch in r)


_DUMMIES = ",\n".join(
    f"CAST(CASE WHEN region_category = '{r}' THEN 1 ELSE 0 END AS INTEGER) AS {_dummy(r)}" for r in REGIONS)
_X_VALUE = ",\n".join(f"{_dummy(r)} * avg_transaction_value AS {_dummy(r)}_x_value" for r in REGIONS)

ENGINEERED = MART + f""",
cohort AS (SELECT * FROM mart WHERE lower(trim(membership_category)) IN ('building', 'household')),
fe0 AS (
  SELECT customer_id, region_category, lower(trim(membership_category)) AS membership_category,
         coalesce(points_in_wallet, 0.0) AS points_in_wallet, joining_date,
         coalesce(avg_transaction_value, 0.0) AS avg_transaction_value,
         coalesce(avg_time_spent, 0.0) AS avg_time_spent,
         coalesce(avg_frequency_login_days, 0.0) AS f0, coalesce(days_since_last_login, 0.0) AS d0,
         event_value_avg, churn,
         greatest(coalesce(CAST(date_diff('day', joining_date, (SELECT max(joining_date) FROM cohort)) AS DOUBLE), 1.0), 1.0)
           AS tenure_days
  FROM cohort),
fe1 AS (SELECT *, points_in_wallet / (tenure_days + 1e-6) AS points_per_day,
               avg_transaction_value / (avg_time_spent + 1e-6) AS value_density,
               points_in_wallet / (avg_time_spent + 1e-6) AS engagement_efficiency FROM fe0),
caps AS (SELECT quantile_cont(avg_transaction_value, 0.99) AS txn_cap,
                quantile_cont(points_per_day, 0.99) AS points_cap FROM fe1),
fe2 AS (SELECT fe1.*, least(avg_transaction_value, txn_cap) AS txn_c, least(points_per_day, points_cap) AS ppd_c,
               greatest(d0, 0.0) AS d1, CASE WHEN f0 = 0 THEN 1.0 ELSE f0 END AS f1 FROM fe1, caps),
fe AS (
  SELECT customer_id, membership_category, points_in_wallet, joining_date, avg_transaction_value, avg_time_spent,
         f1 AS avg_frequency_login_days, d1 AS days_since_last_login, event_value_avg, churn, tenure_days,
         points_per_day, value_density, engagement_efficiency,
         CASE WHEN txn_c > -1 THEN ln(1 + txn_c) END AS log_avg_txn,
         CASE WHEN ppd_c > -1 THEN ln(1 + ppd_c) END AS log_points,
         1.0 / (1 + d1) AS recency_score, 1.0 / f1 AS logins_per_day,
         avg_time_spent / (tenure_days + 1e-6) AS time_per_day,
         {_DUMMIES},
         points_per_day * (avg_time_spent / (tenure_days + 1e-6)) AS points_time_interaction
  FROM fe2),
eng AS (SELECT *, {_X_VALUE} FROM fe)
"""

STATES = ENGINEERED + """,
ch AS (SELECT * FROM eng WHERE churn = 1),
lg AS (SELECT * FROM (UNPIVOT (SELECT points_in_wallet, avg_transaction_value, avg_frequency_login_days, value_density FROM ch)
        ON points_in_wallet, avg_transaction_value, avg_frequency_login_days, value_density
        INTO NAME feature VALUE value) WHERE value IS NOT NULL AND NOT isnan(value)),
mom AS (SELECT feature, avg(value) AS m FROM lg GROUP BY feature),
thr0 AS (SELECT lg.feature, min(value) AS "min", max(value) AS "max",
                quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3,
                quantile_cont(value, 0.4) AS p40, quantile_cont(value, 0.8) AS p80,
                avg(power(value - m, 3)) / power(avg(power(value - m, 2)), 1.5) AS skewness
         FROM lg JOIN mom ON lg.feature = mom.feature GROUP BY lg.feature),
thr AS (SELECT feature, "min", "max", q1, median, q3, skewness,
               CASE WHEN abs(skewness) < 1 THEN 'symmetric' ELSE 'skewed' END AS distribution_type,
               CASE WHEN abs(skewness) < 1 THEN q1 ELSE p40 END AS low_threshold,
               CASE WHEN abs(skewness) < 1 THEN q3 ELSE p80 END AS high_threshold FROM thr0),
st AS (SELECT ch.*,
  CASE WHEN points_in_wallet <= (SELECT low_threshold FROM thr WHERE feature = 'points_in_wallet') THEN 'low'
       WHEN points_in_wallet <= (SELECT high_threshold FROM thr WHERE feature = 'points_in_wallet') THEN 'mid'
       ELSE 'high' END AS points_in_wallet_state,
  CASE WHEN avg_transaction_value <= (SELECT low_threshold FROM thr WHERE feature = 'avg_transaction_value') THEN 'low'
       WHEN avg_transaction_value <= (SELECT high_threshold FROM thr WHERE feature = 'avg_transaction_value') THEN 'mid'
       ELSE 'high' END AS avg_transaction_value_state,
  CASE WHEN avg_frequency_login_days <= (SELECT low_threshold FROM thr WHERE feature = 'avg_frequency_login_days') THEN 'inactive'
       WHEN avg_frequency_login_days <= (SELECT high_threshold FROM thr WHERE feature = 'avg_frequency_login_days') THEN 'irregular'
       ELSE 'consistent' END AS avg_frequency_login_days_state,
  CASE WHEN value_density <= (SELECT low_threshold FROM thr WHERE feature = 'value_density') THEN 'low'
       WHEN value_density <= (SELECT high_threshold FROM thr WHERE feature = 'value_density') THEN 'moderate'
       ELSE 'high' END AS value_density_state
  FROM ch)
"""

ARCHETYPES = STATES + """,
ar AS (SELECT st.*,
  CASE WHEN (avg_transaction_value_state = 'low' AND value_density_state = 'high')
         OR (avg_transaction_value_state = 'high' AND value_density_state = 'low') THEN 'economically_disconnected_user'
       WHEN value_density_state = 'high' AND avg_frequency_login_days_state = 'inactive' THEN 'dormant_former_value_user'
       WHEN value_density_state = 'high' AND (avg_frequency_login_days_state = 'consistent'
         OR avg_transaction_value_state = 'high') THEN 'active_high_value_churner'
       WHEN avg_transaction_value_state = 'low' AND value_density_state = 'moderate' THEN 'partial_adoption_staller'
       WHEN points_in_wallet_state = 'mid' AND avg_transaction_value_state = 'mid'
         AND avg_frequency_login_days_state = 'irregular' AND value_density_state IN ('low', 'moderate')
         THEN 'stable_mid_level_drifter'
       ELSE 'unclassified' END AS behavioral_archetype
  FROM st),
arc AS (SELECT ar.*,
  CAST(CASE behavioral_archetype WHEN 'economically_disconnected_user' THEN 1 WHEN 'dormant_former_value_user' THEN 2
       WHEN 'active_high_value_churner' THEN 3 WHEN 'partial_adoption_staller' THEN 4
       WHEN 'stable_mid_level_drifter' THEN 5 END AS DOUBLE) AS archetype_priority,
  CASE behavioral_archetype
       WHEN 'economically_disconnected_user' THEN 'transaction_value_and_perceived_value_misalignment'
       WHEN 'dormant_former_value_user' THEN 'high_perceived_value_with_behavioral_collapse'
       WHEN 'active_high_value_churner' THEN 'high_value_extraction_despite_eventual_churn'
       WHEN 'partial_adoption_staller' THEN 'moderate_value_realization_without_behavioral_expansion'
       WHEN 'stable_mid_level_drifter' THEN 'behavioral_instability_without_extreme_failure'
       ELSE 'no_rule_triggered' END AS archetype_reason
  FROM ar)
"""

STATE_COLS = ["points_in_wallet_state", "avg_transaction_value_state", "avg_frequency_login_days_state",
              "value_density_state"]

PREVALENCE = ARCHETYPES + f""",
sl AS (UNPIVOT (SELECT {', '.join(STATE_COLS)} FROM st) ON {', '.join(STATE_COLS)} INTO NAME feature VALUE state),
prev0 AS (SELECT feature, state, count(*) AS frequency,
                 count(*) * 100.0 / (SELECT count(*) FROM st) AS prevalence_percentage FROM sl GROUP BY feature, state),
prev AS (SELECT *, sum(prevalence_percentage) OVER (PARTITION BY feature ORDER BY prevalence_percentage DESC, state
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative_prevalence_contribution FROM prev0),
dom AS (SELECT prev.*, CASE WHEN prevalence_percentage >= q66 THEN 'dominant_state'
                            WHEN prevalence_percentage <= q33 THEN 'sparse_state' ELSE 'moderate_state' END
                       AS dominance_classification
        FROM prev JOIN (SELECT feature, quantile_cont(prevalence_percentage, 0.66) AS q66,
                               quantile_cont(prevalence_percentage, 0.33) AS q33 FROM prev GROUP BY feature) t
          USING (feature))
"""


def _pairs_sql() -> str:
    parts = []
    for i, a in enumerate(STATE_COLS):
        for b in STATE_COLS[i + 1:]:
            parts.append(f"SELECT '{a}__{b}' AS feature_pair, '{a}' AS feature_a, '{b}' AS feature_b, "
                         f"{a} AS state_a, {b} AS state_b, count(*) AS joint_frequency FROM st "
                         f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b}")
    return "\nUNION ALL\n".join(parts)


DENSITY = PREVALENCE + f""",
pc0 AS ({_pairs_sql()}),
pc1 AS (SELECT pc0.*, joint_frequency * 100.0 / (SELECT count(*) FROM st) AS joint_prevalence_percentage,
               pa.prevalence_percentage AS marginal_prevalence_a, pb.prevalence_percentage AS marginal_prevalence_b,
               pa.prevalence_percentage * pb.prevalence_percentage / 100 AS expected_joint_prevalence
        FROM pc0 LEFT JOIN prev pa ON pa.feature = feature_a AND pa.state = state_a
                 LEFT JOIN prev pb ON pb.feature = feature_b AND pb.state = state_b),
pc2 AS (SELECT *, joint_prevalence_percentage / expected_joint_prevalence AS co_occurrence_density_ratio FROM pc1),
dens AS (SELECT pc2.*, CASE WHEN co_occurrence_density_ratio >= q75 THEN 'overrepresented_zone'
                            WHEN co_occurrence_density_ratio <= q25 THEN 'sparse_zone' ELSE 'moderate_zone' END
                       AS density_classification
         FROM pc2 JOIN (SELECT feature_pair, quantile_cont(co_occurrence_density_ratio, 0.75) AS q75,
                               quantile_cont(co_occurrence_density_ratio, 0.25) AS q25 FROM pc2 GROUP BY feature_pair) t
           USING (feature_pair))
"""


def with_(ctes: str, body: str) -> str:
    return "WITH " + ctes.strip() + "\n" + body


_TYPES_CACHE: dict[str, list[tuple[str, str]]] = {}


def _describe(sql: str) -> list[tuple[str, str]] | None:
    """Column names and DuckDB types of a statement (binds it on the smallest tables)."""
    if sql in _TYPES_CACHE:
        return _TYPES_CACHE[sql]
    try:
        import duckdb
    except ImportError:
        return None
    con = _describe.con if hasattr(_describe, "con") else None
    if con is None:
        con = duckdb.connect()
        base = "/root/testdata/sf0.001"
        for t in ("region nation customer supplier part orders lineitem events documents embeddings pages "
                  "benchmark labels conversations").split():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{base}/{t}.parquet')")
        _describe.con = con
    try:
        rows = con.execute(f"DESCRIBE {sql}").fetchall()
    except Exception:  # noqa: BLE001 - an unbindable statement is returned unwrapped
        return None
    _TYPES_CACHE[sql] = [(r[0], r[1]) for r in rows]
    return _TYPES_CACHE[sql]


def finish_sql(sql: str) -> str:
    """Keep 10 significant digits of DOUBLE columns (same arithmetic as the Spark side)."""
    cols = _describe(sql)
    if not cols:
        return sql
    sel = []
    for name, typ in cols:
        q = '"' + name.replace('"', '""') + '"'
        if typ in ("DOUBLE", "FLOAT", "REAL"):
            sc = f"pow(10.0, 9.0 - floor(log10(abs({q}))))"
            sel.append(f"CASE WHEN isnan({q}) OR isinf({q}) THEN {q} WHEN {q} = 0 THEN 0.0 "
                       f"ELSE floor({q} * {sc} + 0.484375) / {sc} END AS {q}")
        elif typ.endswith("[]"):
            sel.append(f"array_to_string({q}, ',') AS {q}")
        else:
            sel.append(q)
    return f"SELECT {', '.join(sel)} FROM (\n{sql}\n) AS _q"

TABLE_NAMES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
               "benchmark labels conversations").split()

MART_COLS = ["customer_id", "region_category", "membership_category", "points_in_wallet", "joining_date",
             "avg_transaction_value", "avg_time_spent", "avg_frequency_login_days", "days_since_last_login",
             "event_value_avg", "complaint_status", "feedback", "churn"]
EXPOSURE = ["avg_time_spent", "avg_transaction_value", "avg_frequency_login_days", "points_in_wallet"]


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


EXPOSURE_MEAN_DIFF = _union([
    f"SELECT '{c}' AS feature, avg({c}) FILTER (WHERE churn = 1) AS churned_mean, "
    f"avg({c}) FILTER (WHERE churn = 0) AS retained_mean, "
    f"avg({c}) FILTER (WHERE churn = 1) - avg({c}) FILTER (WHERE churn = 0) AS difference FROM mart"
    for c in EXPOSURE])


def _miss(c: str) -> str:
    return f"CAST({c} IS NULL AS DOUBLE)"


MISSINGNESS = _union([
    f"SELECT '{c}' AS feature, avg({_miss(c)}) FILTER (WHERE churn = 1) AS churn_missing_rate, "
    f"avg({_miss(c)}) FILTER (WHERE churn = 0) AS retained_missing_rate, "
    f"avg({_miss(c)}) FILTER (WHERE churn = 1) - avg({_miss(c)}) FILTER (WHERE churn = 0) AS difference FROM mart"
    for c in MART_COLS])

# Classes of the leakage stage.
_FT = {"region_category": "static", "membership_category": "structural", "avg_time_spent": "behavioral",
       "avg_transaction_value": "behavioral", "avg_frequency_login_days": "behavioral",
       "points_in_wallet": "behavioral", "days_since_last_login": "recency_based",
       "complaint_status": "terminal_or_outcome", "feedback": "terminal_or_outcome", "churn": "terminal_or_outcome"}
_LR = {"complaint_status": "high_risk_terminal", "feedback": "high_risk_terminal", "churn": "high_risk_terminal",
       "avg_time_spent": "exposure_sensitive", "avg_transaction_value": "exposure_sensitive",
       "avg_frequency_login_days": "exposure_sensitive", "points_in_wallet": "exposure_sensitive",
       "days_since_last_login": "temporal_proximity"}
_EC = {"region_category": "pre_outcome_observable", "membership_category": "pre_outcome_observable",
       "avg_time_spent": "exposure_sensitive", "avg_transaction_value": "exposure_sensitive",
       "avg_frequency_login_days": "exposure_sensitive", "points_in_wallet": "exposure_sensitive",
       "complaint_status": "lifecycle_terminal", "feedback": "lifecycle_terminal",
       "days_since_last_login": "retrospective_proxy", "churn": "target"}

LEAKAGE_REGISTER = "SELECT t.*, churn_missing_rate, retained_missing_rate, difference FROM (VALUES " + ", ".join(
    f"('{c}', '{_FT.get(c, 'unknown')}', '{_LR.get(c, 'low_risk')}', '{_EC.get(c, 'administrative_or_unknown')}')"
    for c in MART_COLS) + ") AS t(feature, feature_type, leakage_risk, epistemic_class) JOIN (" + MISSINGNESS + \
    ") m ON m.feature = t.feature"

# Role and priority of the profile stage.
_ROLE = {"region_category": "STRUCTURAL", "membership_category": "STRUCTURAL", "avg_time_spent": "EXPOSURE_SENSITIVE",
         "avg_transaction_value": "EXPOSURE_SENSITIVE", "avg_frequency_login_days": "EXPOSURE_SENSITIVE",
         "points_in_wallet": "EXPOSURE_SENSITIVE", "feedback": "EPISTEMIC", "complaint_status": "EPISTEMIC"}
_PRIO = {"membership_category": "HIGH", "avg_time_spent": "MEDIUM", "avg_transaction_value": "MEDIUM",
         "avg_frequency_login_days": "MEDIUM", "points_in_wallet": "MEDIUM", "feedback": "CONTROLLED",
         "complaint_status": "CONTROLLED"}
PROFILE_COLS = [c for c in MART_COLS if c not in ("customer_id", "joining_date")]
_NUMERIC = ["points_in_wallet", "avg_transaction_value", "avg_time_spent", "avg_frequency_login_days",
            "days_since_last_login", "event_value_avg"]
_CATEG = ["region_category", "membership_category", "complaint_status", "feedback"]
PROFILE_REGISTER = _union([
    f"SELECT '{c}' AS feature, '{'Numerical' if c in _NUMERIC else 'Categorical'}' AS type, "
    f"'{_ROLE.get(c, 'LOW_SIGNAL')}' AS role, '{_PRIO.get(c, 'LOW')}' AS priority, "
    f"count({c}) AS present_count, count(*) - count({c}) AS missing_count FROM mart"
    for c in PROFILE_COLS if c != "churn"])

_MI_NUM = ["customer_id", "points_in_wallet", "avg_transaction_value", "avg_time_spent", "avg_frequency_login_days",
           "days_since_last_login", "event_value_avg"]
_MI_STR = ["region_category", "membership_category", "joining_date", "complaint_status", "feedback"]
MI = MART + f""",
raw AS (UNPIVOT (SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in _MI_NUM + _MI_STR)} FROM mart)
        ON {', '.join(_MI_NUM + _MI_STR)} INTO NAME feature VALUE value),
card AS (SELECT feature FROM raw GROUP BY feature HAVING count(DISTINCT value) <= 50),
l AS (UNPIVOT (SELECT churn, {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in _MI_STR)} FROM mart)
      ON {', '.join(_MI_STR)} INTO NAME feature VALUE value),
ln_ AS (UNPIVOT (SELECT churn, {', '.join(f'CAST(coalesce(CAST({c} AS DOUBLE), 0.0) AS VARCHAR) AS {c}' for c in _MI_NUM)}
        FROM mart) ON {', '.join(_MI_NUM)} INTO NAME feature VALUE value),
tot AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE churn = 1) AS DOUBLE) AS n1 FROM mart),
cells AS (SELECT feature, value, count(*) FILTER (WHERE churn = 1) AS n11, count(*) FILTER (WHERE churn = 0) AS n10
          FROM l WHERE feature IN (SELECT feature FROM card) GROUP BY feature, value),
r AS (SELECT cells.*, row_number() OVER (PARTITION BY feature ORDER BY value) AS rn,
             n, n1, n - n1 AS n0, n11 + n10 AS nx1, n - (n11 + n10) AS nx0 FROM cells, tot),
t AS (SELECT feature || '_' || value AS name, feature AS src,
        (CASE WHEN n11 > 0 THEN n11 / n * ln(n11 * n / (nx1 * n1)) ELSE 0 END)
      + (CASE WHEN n10 > 0 THEN n10 / n * ln(n10 * n / (nx1 * n0)) ELSE 0 END)
      + (CASE WHEN n1 - n11 > 0 THEN (n1 - n11) / n * ln((n1 - n11) * n / (nx0 * n1)) ELSE 0 END)
      + (CASE WHEN n0 - n10 > 0 THEN (n0 - n10) / n * ln((n0 - n10) * n / (nx0 * n0)) ELSE 0 END) AS mi
      FROM r WHERE rn > 1),
ncells AS (SELECT feature, value, count(*) FILTER (WHERE churn = 1) AS n11, count(*) FILTER (WHERE churn = 0) AS n10
           FROM ln_ WHERE feature IN (SELECT feature FROM card) GROUP BY feature, value),
nt AS (SELECT feature AS name, feature AS src,
         sum((CASE WHEN n11 > 0 THEN n11 / n * ln(n11 * n / ((n11 + n10) * n1)) ELSE 0 END)
           + (CASE WHEN n10 > 0 THEN n10 / n * ln(n10 * n / ((n11 + n10) * (n - n1))) ELSE 0 END)) AS mi
       FROM ncells, tot GROUP BY feature),
allmi AS (SELECT * FROM t UNION ALL SELECT * FROM nt)
"""

MUTUAL_INFORMATION = """
SELECT name AS feature, mi AS mutual_info_score,
       CASE src WHEN 'region_category' THEN 'pre_outcome_observable'
                WHEN 'membership_category' THEN 'pre_outcome_observable'
                WHEN 'complaint_status' THEN 'lifecycle_terminal' WHEN 'feedback' THEN 'lifecycle_terminal'
                WHEN 'avg_time_spent' THEN 'exposure_sensitive' WHEN 'avg_transaction_value' THEN 'exposure_sensitive'
                WHEN 'avg_frequency_login_days' THEN 'exposure_sensitive' WHEN 'points_in_wallet' THEN 'exposure_sensitive'
                WHEN 'days_since_last_login' THEN 'retrospective_proxy'
                ELSE 'administrative_or_unknown' END AS epistemic_class
FROM allmi"""

PROFILE = MART + f""",
ss AS (SELECT * EXCLUDE (customer_id, joining_date), row_number() OVER () AS rid FROM mart),
nl AS (UNPIVOT (SELECT rid, churn, {', '.join(_NUMERIC)} FROM ss) ON {', '.join(_NUMERIC)}
       INTO NAME feature VALUE x),
nm AS (SELECT feature, avg(x) AS m FROM nl GROUP BY feature),
np AS (SELECT nl.feature, avg(x) AS mean, quantile_cont(x, 0.5) AS median, stddev_samp(x) AS std,
              avg(power(x - m, 3)) / power(avg(power(x - m, 2)), 1.5) AS skewness,
              avg(power(x - m, 4)) / power(avg(power(x - m, 2)), 2) - 3 AS kurtosis
       FROM nl JOIN nm ON nl.feature = nm.feature GROUP BY nl.feature),
strat AS (SELECT feature, CASE WHEN feature IN ({', '.join("'" + c + "'" for c in EXPOSURE)})
                                 OR abs(skewness) > 1 THEN 'quantile' ELSE 'width' END AS strategy FROM np),
clipq AS (SELECT quantile_cont(x, 0.01) AS p1, quantile_cont(x, 0.99) AS p99 FROM nl
          WHERE feature = 'avg_transaction_value'),
nb0 AS (SELECT nl.*, CASE WHEN feature = 'avg_transaction_value' THEN least(greatest(x, p1), p99) ELSE x END AS b
        FROM nl, clipq),
edges AS (SELECT feature, quantile_cont(b, [0.0, 1.0/3.0, 2.0/3.0, 1.0]) AS e, min(b) AS mn, max(b) AS mx
          FROM nb0 GROUP BY feature),
nb AS (SELECT nb0.*, strategy,
         CASE WHEN strategy = 'quantile' THEN
                CASE WHEN e[1] = e[2] OR e[2] = e[3] OR e[3] = e[4] THEN NULL
                     WHEN b <= e[2] THEN 'LOW' WHEN b <= e[3] THEN 'MEDIUM' WHEN b <= e[4] THEN 'HIGH' END
              ELSE CASE WHEN mx = mn THEN 'MEDIUM' WHEN b <= mn + (mx - mn) / 3.0 THEN 'LOW'
                        WHEN b <= mn + 2 * ((mx - mn) / 3.0) THEN 'MEDIUM' ELSE 'HIGH' END END AS bracket
       FROM nb0 JOIN edges USING (feature) JOIN strat USING (feature)),
nbs AS (SELECT feature, bracket, any_value(strategy) AS strategy, count(*) AS count,
               count(*) / (SELECT count(*) FROM ss) AS proportion, avg(x) AS mean, var_samp(x) AS variance,
               avg(churn) AS churn_rate FROM nb WHERE bracket IS NOT NULL GROUP BY feature, bracket),
cl AS (UNPIVOT (SELECT churn, {', '.join(_CATEG)} FROM ss) ON {', '.join(_CATEG)} INTO NAME feature VALUE value),
cr AS (SELECT feature, value, avg(churn) AS rate FROM cl GROUP BY feature, value),
rk AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY rate, value) - 1 AS i,
              count(*) OVER (PARTITION BY feature) AS n FROM cr),
rb AS (SELECT feature, value, CASE WHEN i < n // 3 THEN 'LOW' WHEN i < (2 * n) // 3 THEN 'MEDIUM' ELSE 'HIGH' END
              AS bracket FROM rk),
cbs AS (SELECT feature, bracket, count(*) AS count, count(*) / (SELECT count(*) FROM ss) AS proportion,
               avg(churn) AS churn_rate FROM cl JOIN rb USING (feature, value) GROUP BY feature, bracket)
"""

NUMERIC_PROFILE = "SELECT feature, mean, median, std, skewness, kurtosis, " \
                  "CASE WHEN mean <> 0 THEN std / mean END AS cv FROM np"

CORR_PROFILE = _union([
    f"SELECT '{c}' AS feature, "
    f"covar_pop({c}, churn) FILTER (WHERE {c} IS NOT NULL) / nullif(stddev_pop({c}) * "
    f"stddev_pop(churn) FILTER (WHERE {c} IS NOT NULL), 0) AS corr_churn, " +
    (f"covar_pop({c}, avg_frequency_login_days) FILTER (WHERE {c} IS NOT NULL AND avg_frequency_login_days IS NOT NULL)"
     f" / nullif(stddev_pop({c}) FILTER (WHERE avg_frequency_login_days IS NOT NULL) * stddev_pop(avg_frequency_login_days)"
     f" FILTER (WHERE {c} IS NOT NULL), 0)" if c != "avg_frequency_login_days" else "CAST(NULL AS DOUBLE)")
    + " AS corr_exposure_proxy FROM ss" for c in _NUMERIC])

CATEGORICAL_PROFILE = """
SELECT feature, value, count(*) AS count, count(*) / sum(count(*)) OVER (PARTITION BY feature) AS proportion,
       avg(churn) AS churn_rate FROM cl GROUP BY feature, value"""

BRACKET_PATTERN = """
SELECT feature, CASE WHEN lo IS NULL OR md IS NULL OR hi IS NULL THEN 'FLAT'
                     WHEN (lo < md AND md < hi) OR (lo > md AND md > hi) THEN 'MONOTONIC'
                     WHEN greatest(lo, md, hi) = hi THEN 'THRESHOLD' ELSE 'NON_MONOTONIC' END AS pattern
FROM (SELECT feature, max(CASE WHEN bracket = 'LOW' THEN churn_rate END) AS lo,
             max(CASE WHEN bracket = 'MEDIUM' THEN churn_rate END) AS md,
             max(CASE WHEN bracket = 'HIGH' THEN churn_rate END) AS hi
      FROM (SELECT feature, bracket, churn_rate FROM nbs UNION ALL SELECT feature, bracket, churn_rate FROM cbs)
      GROUP BY feature)"""

# ------------------------------------------------------------------ engineered table columns (in order)
_DUMS = [_dummy(r) for r in REGIONS]
ENG_COLS = [("customer_id", "bigint"), ("membership_category", "string"), ("points_in_wallet", "double"),
            ("joining_date", "date"), ("avg_transaction_value", "double"), ("avg_time_spent", "double"),
            ("avg_frequency_login_days", "double"), ("days_since_last_login", "double"),
            ("event_value_avg", "double"), ("churn", "int"), ("tenure_days", "double"),
            ("points_per_day", "double"), ("value_density", "double"), ("engagement_efficiency", "double"),
            ("log_avg_txn", "double"), ("log_points", "double"), ("recency_score", "double"),
            ("logins_per_day", "double"), ("time_per_day", "double")] + \
    [(d, "int") for d in _DUMS] + [("points_time_interaction", "double")] + \
    [(f"{d}_x_value", "double") for d in _DUMS]


def _q(c: str) -> str:
    return '"' + c + '"'


def _tercile_cte(name: str, col: str) -> str:
    return f"{name} AS (SELECT quantile_cont({col}, [0.0, 1.0/3.0, 2.0/3.0, 1.0]) AS e FROM eng WHERE {col} IS NOT NULL)"


def _band(col: str, edges: str, labels=("Low", "Mid", "High")) -> str:
    e = f"(SELECT e FROM {edges})"
    return (f"CASE WHEN {e}[1] = {e}[2] OR {e}[2] = {e}[3] OR {e}[3] = {e}[4] OR {col} IS NULL THEN NULL "
            f"WHEN {col} <= {e}[2] THEN '{labels[0]}' WHEN {col} <= {e}[3] THEN '{labels[1]}' "
            f"WHEN {col} <= {e}[4] THEN '{labels[2]}' END")


_BANDED = ["avg_transaction_value", "points_in_wallet", "avg_frequency_login_days", "value_density", "tenure_days"]

TARGET = ENGINEERED + ",\n" + ",\n".join(_tercile_cte(f"ed_{c}", c) for c in _BANDED) + f""",
bands AS (SELECT churn, membership_category, avg_transaction_value, avg_frequency_login_days,
                 {_band('avg_transaction_value', 'ed_avg_transaction_value')} AS b_txn,
                 {_band('points_in_wallet', 'ed_points_in_wallet')} AS b_pts,
                 {_band('avg_frequency_login_days', 'ed_avg_frequency_login_days')} AS b_freq,
                 {_band('value_density', 'ed_value_density')} AS b_dens,
                 {_band('tenure_days', 'ed_tenure_days', ('Early', 'Mid', 'Late'))} AS phase,
                 {', '.join(_DUMS)} FROM eng),
seg0 AS (SELECT 'membership_category' AS t, membership_category AS n, churn FROM bands WHERE membership_category IS NOT NULL
  {''.join(f" UNION ALL SELECT 'region', '{d[len('region_'):]}', churn FROM bands WHERE {d} = 1" for d in _DUMS)}
  UNION ALL SELECT 'avg_transaction_value', b_txn, churn FROM bands WHERE b_txn IS NOT NULL
  UNION ALL SELECT 'points_in_wallet', b_pts, churn FROM bands WHERE b_pts IS NOT NULL),
segs AS (SELECT t AS segment_type, n AS segment_name, count(*) AS customer_count, avg(churn) AS churn_rate
         FROM seg0 GROUP BY t, n),
tg0 AS (SELECT phase AS tenure_phase, count(*) AS count, avg(churn) AS churn_rate,
               avg(avg_transaction_value) AS mean_transaction_value,
               avg(avg_frequency_login_days) AS mean_login_frequency FROM bands WHERE phase IS NOT NULL GROUP BY phase),
tgeo AS (SELECT *, 1 - churn_rate AS non_churn_rate,
                churn_rate / nullif(1 - churn_rate, 0) AS churn_nonchurn_ratio,
                churn_rate / (SELECT avg(churn) FROM eng) AS concentration_index FROM tg0)
"""

IMBALANCE = """
SELECT max(churn_rate) AS max_segment_churn_rate, min(churn_rate) AS min_segment_churn_rate,
       max(churn_rate) / nullif(min(churn_rate), 0) AS imbalance_ratio, var_samp(churn_rate) AS segment_churn_variance
FROM segs"""

BAND_SEPARATION = _union([
    f"""SELECT '{f}' AS feature, avg(churn) FILTER (WHERE {b} = 'Low') AS lo, avg(churn) FILTER (WHERE {b} = 'Mid') AS md,
               avg(churn) FILTER (WHERE {b} = 'High') AS hi FROM bands"""
    for f, b in [("avg_transaction_value", "b_txn"), ("points_in_wallet", "b_pts"),
                 ("avg_frequency_login_days", "b_freq"), ("value_density", "b_dens")]])
BAND_SEPARATION = f"""
SELECT feature, lo AS low_band_churn, md AS mid_band_churn, hi AS high_band_churn,
  CASE WHEN len(v) < 3 THEN 'unstable' WHEN v[1] <= v[2] AND v[2] <= v[3] THEN 'increasing'
       WHEN v[1] >= v[2] AND v[2] >= v[3] THEN 'decreasing' ELSE 'unstable' END AS monotonicity,
  greatest(lo, md, hi) - least(lo, md, hi) AS churn_spread
FROM (SELECT *, list_filter([lo, md, hi], lambda x: x IS NOT NULL) AS v FROM ({BAND_SEPARATION}))"""


def _metrics(pred: str) -> str:
    tp = f"sum(CASE WHEN churn = 1 AND ({pred}) = 1 THEN 1 ELSE 0 END)"
    fp = f"sum(CASE WHEN churn = 0 AND ({pred}) = 1 THEN 1 ELSE 0 END)"
    fn = f"sum(CASE WHEN churn = 1 AND ({pred}) = 0 THEN 1 ELSE 0 END)"
    return (f"avg(CASE WHEN churn = ({pred}) THEN 1.0 ELSE 0.0 END) AS accuracy, "
            f"CAST(CASE WHEN {tp} + {fp} = 0 THEN 0.0 ELSE {tp} / ({tp} + {fp}) END AS DOUBLE) AS precision, "
            f"CAST(CASE WHEN {tp} + {fn} = 0 THEN 0.0 ELSE {tp} / ({tp} + {fn}) END AS DOUBLE) AS recall, "
            f"CAST({fn} / greatest({tp} + {fn}, 1) AS DOUBLE) AS false_negative_rate")


_RULES = [("low_transaction_value", "avg_transaction_value"), ("low_points_in_wallet", "points_in_wallet"),
          ("low_login_frequency", "avg_frequency_login_days")]
BASELINE_RULES = _union(
    [f"SELECT 'predict_non_churn' AS rule_name, 'full_dataset' AS scope, {_metrics('0')} FROM eng"] +
    [f"SELECT '{r}', 'full_dataset', {_metrics(f'CASE WHEN {c} <= (SELECT quantile_cont({c}, 0.33) FROM eng) THEN 1 ELSE 0 END')} FROM eng"
     for r, c in _RULES] +
    ["SELECT 'predict_non_churn', membership_category, " + _metrics('0') +
     " FROM eng WHERE membership_category IS NOT NULL GROUP BY membership_category"])

LIFECYCLE = """
SELECT tenure_phase AS lifecycle_phase, 'Insufficient stage-local ranking' AS strongest_behavior_signal,
       'Insufficient stage-local evidence' AS weakest_signal_zone,
       CASE tenure_phase WHEN 'Early' THEN 'activation / onboarding' WHEN 'Mid' THEN 'engagement / usage'
            WHEN 'Late' THEN 'fatigue / value decay' ELSE 'review' END AS engineering_priority
FROM tgeo"""

# ------------------------------------------------------------------ triage

_TIME_KW = ["date", "time", "last_visit", "joining"]
_RATE_KW = ["per_day", "density", "frequency", "efficiency", "score", "interaction"]
_AMBIG = {"avg_frequency_login_days", "recency_score", "days_since_last_login", "log_avg_txn",
          "points_time_interaction", "joining_date", "last_visit_time"}
_DIAG = {"days_since_last_login", "recency_score", "last_visit_time"}
_HIGH = {"points_in_wallet", "avg_transaction_value", "value_density"}
_SECOND = {"membership_category", "avg_frequency_login_days", "tenure_days"} | set(_DUMS)
_DISCARD = {"log_points"} | {f"{d}_x_value" for d in _DUMS}
_EXCL = {"log_points", "security_no", "referral_id"} | {f"{d}_x_value" for d in _DUMS}
_NOTE = {"points_in_wallet": "Strong prior churn separation; validate timing.",
         "avg_frequency_login_days": "Strong behavior signal; semantic timing unclear.",
         "log_points": "Previously failed integrity checks.",
         "tenure_days": "Requires datatype and distribution validation."}


def _triage_row(i: int, c: str, t: str) -> str:
    if any(k in c.lower() for k in _TIME_KW):
        sc = "'Time-based'"
    elif any(k in c.lower() for k in _RATE_KW):
        sc = "'Engineered rate / metric'"
    elif t in ("int", "bigint", "double"):
        nu = f"(SELECT count(DISTINCT {_q(c)}) FROM eng)"
        disc = f"WHEN {nu} <= 20 THEN 'Discrete numeric' " if t in ("int", "bigint") else ""
        sc = f"CASE WHEN {nu} = 2 THEN 'Binary indicator' {disc}ELSE 'Continuous numeric' END"
    else:
        sc = "'Categorical'"
    adm = ("Outcome-relative (diagnostic-only)" if c in _DIAG else "Ambiguous" if c in _AMBIG
           else "Pre-decision admissible")
    pri = ("High-priority" if c in _HIGH else "Secondary" if c in _SECOND else "Discard" if c in _DISCARD
           else "Secondary")
    path = ("Exclusion Candidates" if c in _EXCL or pri == "Discard" else
            "Diagnostic-Only Variables" if adm.startswith("Outcome") else
            "Conditional Candidates" if adm == "Ambiguous" else "Approved Predictive Candidates")
    note = _NOTE.get(c) or ("Needs business definition review." if adm == "Ambiguous" else
                            "Use only for diagnostic exploration." if path.startswith("Diagnostic") else "")
    return (f"SELECT {i} AS position, '{c}' AS feature, {sc} AS structural_class, '{adm}' AS admissibility_label, "
            f"'{pri}' AS priority_tier, '{path}' AS final_pathway_assignment, '{note}' AS notes_risks")


TRIAGE = ENGINEERED + ",\nreg AS (" + _union(
    [_triage_row(i, c, t) for i, (c, t) in enumerate([x for x in ENG_COLS if x[0] != "churn"])]) + ")\n"

PATHWAY_LISTS = """
SELECT p.pathway, coalesce(string_agg(feature, ',' ORDER BY position), '') AS features,
       CAST(count(feature) AS INTEGER) AS feature_count
FROM (VALUES ('Approved Predictive Candidates'), ('Conditional Candidates'), ('Diagnostic-Only Variables'),
             ('Leakage / Post-Outcome Risks'), ('Exclusion Candidates')) p(pathway)
LEFT JOIN reg ON reg.final_pathway_assignment = p.pathway GROUP BY p.pathway"""

_APPROVED = [c for c, t in ENG_COLS if c not in ("churn", "customer_id") and c not in _EXCL and c not in _DISCARD
             and c not in _DIAG and c not in _AMBIG]
PREDICTIVE_READY = f"SELECT {', '.join(_q(c) for c in _APPROVED)}, churn FROM eng"

TENURE_VALIDATION = """
SELECT 'tenure_days' AS feature, count(tenure_days) AS non_null_count, count(*) FILTER (WHERE tenure_days IS NULL)
         AS null_count, count(DISTINCT tenure_days) AS unique_values, min(tenure_days) AS min_value,
       max(tenure_days) AS max_value, count(*) FILTER (WHERE tenure_days < 0) AS negative_count FROM eng"""

# ------------------------------------------------------------------ validation of engineered features

_LOGS = [c for c, _ in ENG_COLS if c.startswith("log_")]
_INTER = [c for c, _ in ENG_COLS if any(m in c.lower() for m in ("interaction", "_x_", "*_", "_mul_"))]
_NUM = [c for c, t in ENG_COLS if t in ("int", "bigint", "double") and c not in ("churn", "customer_id")]

INTEGRITY = _union([
    f"SELECT '{c}' AS feature_name, CASE WHEN {'neg > 0 OR ' if c in _LOGS else ''}inf > 0 OR nan > 0 THEN 'FAIL' "
    f"ELSE 'PASS' END AS validity_status, CASE "
    + (f"WHEN neg > 0 THEN 'distortion' " if c in _LOGS else "") +
    f"WHEN inf > 0 THEN 'Inf' WHEN nan > 0 THEN 'NaN' ELSE 'none' END AS anomaly_type FROM "
    f"(SELECT count(*) FILTER (WHERE {_q(c)} IS NULL OR isnan({_q(c)})) AS nan, "
    f"count(*) FILTER (WHERE isinf({_q(c)})) AS inf, count(*) FILTER (WHERE {_q(c)} < 0) AS neg FROM eng)"
    for c in sorted(set(_LOGS) | set(_INTER))])


def _skew(c: str) -> str:
    m = f"(SELECT avg({c}) FROM eng)"
    return f"avg(power({c} - {m}, 3)) / power(avg(power({c} - {m}, 2)), 1.5)"


PATHOLOGY = f"""
SELECT feature_pair, skew_delta, variance_delta,
       CASE WHEN skew_delta < 0 THEN 'improved' WHEN skew_delta > 0 THEN 'worsened' ELSE 'unchanged' END
         AS correction_status
FROM ({_union([f"SELECT '{p} -> {lg}' AS feature_pair, abs({_skew(lg)}) - abs({_skew(p)}) AS skew_delta, "
               f"stddev_samp({lg}) - stddev_samp({p}) AS variance_delta, count({p}) AS n1, count({lg}) AS n2 FROM eng"
               for lg, p in [("log_avg_txn", "avg_transaction_value"), ("log_points", "points_per_day")]])})
WHERE n1 > 3 AND n2 > 3"""


def _cohen(c: str, where: str = "") -> str:
    a = f"FILTER (WHERE churn = 1{where})"
    b = f"FILTER (WHERE churn = 0{where})"
    n1, n2 = f"count({c}) {a}", f"count({c}) {b}"
    pooled = f"sqrt((({n1} - 1) * var_samp({c}) {a} + ({n2} - 1) * var_samp({c}) {b}) / ({n1} + {n2} - 2))"
    return (f"CASE WHEN {n1} >= 2 AND {n2} >= 2 AND {pooled} <> 0 THEN "
            f"(avg({c}) {a} - avg({c}) {b}) / {pooled} END")


def _scorr(x: str, y: str) -> str:
    f = f"FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    return (f"CASE WHEN count({x}) {f} >= 3 AND min({x}) {f} <> max({x}) {f} AND min({y}) {f} <> max({y}) {f} "
            f"THEN covar_pop({x}, {y}) {f} / (stddev_pop({x}) {f} * stddev_pop({y}) {f}) END")


SIGNAL = f"""
SELECT feature, effect_size, churn_correlation,
       CASE WHEN effect_size IS NOT NULL THEN abs(effect_size) + coalesce(abs(churn_correlation), 0) END
         AS net_signal_gain
FROM ({_union([f"SELECT '{c}' AS feature, {_cohen(_q(c))} AS effect_size, {_scorr(_q(c), 'churn')} AS churn_correlation FROM eng"
               for c in _NUM])})"""


def _parents(feature: str) -> list[str]:
    import re
    out = set()
    for tok in re.split(r"_x_|_mul_|interaction", feature.lower()):
        tok = tok.strip("_ ")
        if tok:
            out |= {c for c in _NUM if tok in c.lower() and c != feature}
    return sorted(out)


def _inter_row(c: str) -> str:
    ps = _parents(c)
    red = ("CAST(NULL AS DOUBLE)" if not ps else
           f"(SELECT max(v) FROM (SELECT unnest([{', '.join('abs(' + _scorr(_q(c), _q(p)) + ')' for p in ps)}]) AS v))")
    best = ("0.0" if not ps else
            f"coalesce((SELECT max(v) FROM (SELECT unnest([{', '.join('abs(' + _scorr(_q(p), 'churn') + ')' for p in ps)}]) AS v)), 0.0)")
    return f"SELECT '{c}' AS interaction_feature, {red} AS redundancy_score, abs({_scorr(_q(c), 'churn')}) - {best} AS marginal_gain FROM eng"


INTERACTION_EVAL = f"""
SELECT interaction_feature, redundancy_score, marginal_gain,
       CASE WHEN marginal_gain IS NULL THEN 'harmful'
            WHEN marginal_gain > 0.02 AND (redundancy_score IS NULL OR redundancy_score < 0.95) THEN 'useful'
            WHEN redundancy_score >= 0.95 THEN 'redundant' ELSE 'harmful' END AS classification
FROM ({_union([_inter_row(c) for c in _INTER])})"""

SEGMENT_SEPARATION = f"""
SELECT segment, churn_rate, separation_strength,
       CASE WHEN separation_strength >= 0.5 THEN 'strong structural stratifier'
            WHEN separation_strength >= 0.2 THEN 'weak/noisy segmentation variable' ELSE 'misleading proxy' END
         AS structural_role
FROM (SELECT membership_category AS segment, avg(churn) AS churn_rate,
             list_avg(list_filter([{', '.join('abs(' + _cohen(c) + ')' for c in _LOGS)}], lambda x: x IS NOT NULL))
               AS separation_strength
      FROM eng WHERE membership_category IS NOT NULL GROUP BY membership_category)"""

# ------------------------------------------------------------------ progression (archetype level)

def _med(col: str, alias: str) -> str:
    return f"quantile_cont({col}, 0.5) AS {alias}"


PROGRESSION = ARCHETYPES + """,
life AS (SELECT behavioral_archetype, quantile_cont(tenure_days, 0.5) AS median_tenure_days,
                avg(tenure_days) AS mean_tenure_days, stddev_samp(tenure_days) AS tenure_std,
                quantile_cont(points_per_day, 0.5) AS median_points_per_day,
                quantile_cont(engagement_efficiency, 0.5) AS median_engagement_efficiency,
                quantile_cont(avg_transaction_value, 0.5) AS median_transaction_value,
                count(behavioral_archetype) AS archetype_population FROM arc GROUP BY behavioral_archetype),
decay AS (SELECT behavioral_archetype, quantile_cont(days_since_last_login, 0.5) AS median_days_since_last_login,
                 quantile_cont(recency_score, 0.5) AS median_recency_score,
                 quantile_cont(engagement_efficiency, 0.5) AS median_engagement_efficiency,
                 quantile_cont(time_per_day, 0.5) AS median_time_per_day,
                 stddev_samp(days_since_last_login) AS inactivity_std FROM arc GROUP BY behavioral_archetype),
flags AS (SELECT behavioral_archetype,
   CASE WHEN avg_transaction_value_state = 'high' AND value_density_state = 'low' THEN 1 ELSE 0 END AS high_spend_low_value_flag,
   CASE WHEN avg_transaction_value_state = 'low' AND value_density_state = 'high' THEN 1 ELSE 0 END AS low_spend_high_value_flag,
   CASE WHEN avg_frequency_login_days_state = 'inactive' AND value_density_state = 'high' THEN 1 ELSE 0 END AS inactive_high_value_flag,
   CASE WHEN avg_frequency_login_days_state = 'consistent' AND avg_transaction_value_state = 'low' THEN 1 ELSE 0 END
     AS high_engagement_low_monetization_flag,
   CASE WHEN avg_frequency_login_days_state = 'irregular' AND avg_transaction_value_state = 'mid' THEN 1 ELSE 0 END
     AS irregular_mid_behavior_flag FROM arc),
inst AS (SELECT behavioral_archetype, avg(high_spend_low_value_flag) * 100 AS high_spend_low_value_flag,
                avg(low_spend_high_value_flag) * 100 AS low_spend_high_value_flag,
                avg(inactive_high_value_flag) * 100 AS inactive_high_value_flag,
                avg(high_engagement_low_monetization_flag) * 100 AS high_engagement_low_monetization_flag,
                avg(irregular_mid_behavior_flag) * 100 AS irregular_mid_behavior_flag FROM flags GROUP BY 1)
"""

LIFECYCLE_POSITIONING = """
SELECT *, CAST(dense_rank() OVER (ORDER BY median_tenure_days) AS DOUBLE) AS lifecycle_maturity_rank FROM life"""
STATE_MIX = """
SELECT behavioral_archetype, avg_frequency_login_days_state, count(*) AS frequency,
       count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY behavioral_archetype) AS state_percentage
FROM arc GROUP BY 1, 2"""
INSTABILITY_PROFILES = """
SELECT *, (high_spend_low_value_flag + low_spend_high_value_flag + inactive_high_value_flag
           + high_engagement_low_monetization_flag + irregular_mid_behavior_flag) / 5 AS overall_instability_score
FROM inst"""

# ------------------------------------------------------------------ inferential stage

_INF_FEATS = ["avg_transaction_value", "value_density", "engagement_efficiency", "points_per_day",
              "wallet_balance", "logins_per_day"]
_VEC = ["points_per_day", "engagement_efficiency", "avg_transaction_value", "value_density", "recency_score",
        "time_per_day"]
_FLAGS = [("high_spend_low_value_flag", "avg_transaction_value_state", "high", "value_density_state", "low"),
          ("low_spend_high_value_flag", "avg_transaction_value_state", "low", "value_density_state", "high"),
          ("inactive_high_value_flag", "avg_frequency_login_days_state", "inactive", "value_density_state", "high"),
          ("high_engagement_low_monetization_flag", "avg_frequency_login_days_state", "consistent",
           "avg_transaction_value_state", "low"),
          ("irregular_mid_behavior_flag", "avg_frequency_login_days_state", "irregular",
           "avg_transaction_value_state", "mid")]
_STATE6 = ["avg_transaction_value_state", "value_density_state", "engagement_efficiency_state",
           "points_per_day_state", "wallet_balance_state", "avg_frequency_login_days_state"]


def _tq(f: str) -> str:
    e = f"(SELECT e FROM iq_{f})"
    return (f"CASE WHEN {e}[1] = {e}[2] OR {e}[2] = {e}[3] OR {e}[3] = {e}[4] THEN 'mid' WHEN {f} IS NULL THEN NULL "
            f"WHEN {f} <= {e}[2] THEN 'low' WHEN {f} <= {e}[3] THEN 'mid' WHEN {f} <= {e}[4] THEN 'high' END")


INF = MART + """,
inf0 AS (SELECT * REPLACE (trim(replace(lower(trim(membership_category)), ' membership', '')) AS membership_category,
                           coalesce(points_in_wallet, 0.0) AS points_in_wallet,
                           coalesce(avg_transaction_value, 0.0) AS avg_transaction_value,
                           coalesce(avg_time_spent, 0.0) AS avg_time_spent,
                           coalesce(days_since_last_login, 0.0) AS days_since_last_login,
                           coalesce(avg_frequency_login_days, 1.0) AS avg_frequency_login_days,
                           CASE churn WHEN 1 THEN 'yes' WHEN 0 THEN 'no' END AS churn),
                coalesce(CAST(date_diff('day', joining_date, (SELECT max(joining_date) FROM mart)) AS DOUBLE), 1.0) AS t0
         FROM mart),
inf1 AS (SELECT * EXCLUDE (t0), CASE WHEN t0 = 0 THEN 1.0 ELSE t0 END AS tenure_days FROM inf0 WHERE churn IS NOT NULL),
inf2 AS (SELECT *, points_in_wallet / (tenure_days + 1) AS points_per_day,
                avg_transaction_value / (avg_time_spent + 1) AS value_density,
                1.0 / (days_since_last_login + 1) AS recency_score, 1.0 / (avg_frequency_login_days + 1) AS logins_per_day,
                avg_time_spent / (tenure_days + 1) AS time_per_day, points_in_wallet AS wallet_balance FROM inf1),
inf3 AS (SELECT *, points_per_day / (avg_time_spent + 1) AS engagement_efficiency FROM inf2),
""" + ",\n".join(f"iq_{f} AS (SELECT quantile_cont({f}, [0.0, 1.0/3.0, 2.0/3.0, 1.0]) AS e FROM inf3 "
                 f"WHERE {f} IS NOT NULL AND NOT isnan({f}))" for f in _INF_FEATS) + """,
inf4 AS (SELECT *, """ + ", ".join(f"{_tq(f)} AS {f}_state" for f in _INF_FEATS) + """,
                CASE WHEN avg_frequency_login_days IS NULL THEN NULL WHEN avg_frequency_login_days <= 190 THEN 'consistent'
                     WHEN avg_frequency_login_days <= 250 THEN 'irregular' ELSE 'inactive' END
                  AS avg_frequency_login_days_state FROM inf3),
inf AS (SELECT *, """ + ", ".join(
    f"CASE WHEN {a} = '{av}' AND {b} = '{bv}' THEN 1 ELSE 0 END AS {n}" for n, a, av, b, bv in _FLAGS) + """,
               membership_category || '_' || CASE WHEN churn = 'yes' THEN 'churned' ELSE 'retained' END AS population
        FROM inf4),
clean AS (SELECT * FROM inf WHERE """ + " AND ".join(
    f"{c} IS NOT NULL AND NOT isnan({c}) AND NOT isinf({c})" for c in _VEC) + """),
pvec AS (SELECT population, [""" + ", ".join(f"quantile_cont({c}, 0.5)" for c in _VEC) + """] AS v
         FROM clean GROUP BY population),
rvec AS (SELECT coalesce((SELECT [""" + ", ".join(f"quantile_cont({c}, 0.5)" for c in _VEC) + """]
         FROM clean WHERE population IN ('building_churned', 'household_churned') HAVING count(*) > 0),
         [0.0, 0.0, 0.0, 0.0, 0.0, 0.0]) AS u)
"""


def _state_stats(c: str, domain: list[str], where: str = "") -> str:
    ns = [f"CAST(count(*) FILTER (WHERE {c} = '{lvl}'{where}) AS DOUBLE)" for lvl in domain]
    tot = "(" + " + ".join(ns) + ")"
    ps = [f"{n} / {tot}" for n in ns]
    ent = "-(" + " + ".join(f"CASE WHEN {p} > 0 THEN {p} * ln({p}) ELSE 0.0 END" for p in ps) + ")"
    gini = "1 - (" + " + ".join(f"{p} * {p}" for p in ps) + ")"
    disp = f"list_aggregate([{', '.join(ps)}], 'stddev_samp')"
    empty = f"{tot} = 0"
    return (f"CASE WHEN {empty} THEN 0.0 ELSE {ent} END AS {c}_entropy, "
            f"CASE WHEN {empty} THEN 0.0 ELSE {gini} END AS {c}_gini, "
            f"CASE WHEN {empty} THEN 0.0 ELSE {disp} END AS {c}_dispersion")


def _domain(c: str) -> list[str]:
    return ["consistent", "irregular", "inactive"] if c.startswith("avg_frequency") else ["low", "mid", "high"]


_FLAG_NAMES = [f[0] for f in _FLAGS]

POPULATION_PROFILES_BODY = f"""
SELECT p.population, population_size, {', '.join(s for s in [f'{c}_entropy, {c}_gini, {c}_dispersion' for c in _STATE6])},
       {', '.join(f'{n}_prevalence' for n in _FLAG_NAMES)},
       sqrt(0.0 + {' + '.join(f'coalesce(v[{i + 1}], 0.0) * coalesce(v[{i + 1}], 0.0)' for i in range(6))})
         AS behavioral_vector_norm,
       instability_index
FROM (SELECT population, count(*) AS population_size, {', '.join(_state_stats(c, _domain(c)) for c in _STATE6)},
             {', '.join(f'avg({n}) AS {n}_prevalence' for n in _FLAG_NAMES)},
             avg(({' + '.join(_FLAG_NAMES)}) / 5) AS instability_index
      FROM inf GROUP BY population HAVING count(*) >= 3) p LEFT JOIN pvec USING (population)"""

REFERENCE_STATISTICS = f"""
SELECT {', '.join(_state_stats(c, _domain(c)) for c in _STATE6)},
       {', '.join(f'avg({n}) AS {n}_prevalence' for n in _FLAG_NAMES)}
FROM inf WHERE population IN ('building_churned', 'household_churned')"""


def _sum(terms: list[str]) -> str:
    return "(0.0 + " + " + ".join(terms) + ")"


def _js_g(t: str, terms: int = 25) -> str:
    """(1+t)ln(1+t) + (1-t)ln(1-t): series sum t^(2k)/(k(2k-1)) for |t| < 1/2, closed form otherwise."""
    acc = repr(1.0 / (terms * (2 * terms - 1)))
    for k in range(terms - 1, 0, -1):
        acc = f"({repr(1.0 / (k * (2 * k - 1)))} + {t} * {t} * {acc})"
    return (f"(CASE WHEN abs({t}) < 0.5 THEN {t} * {t} * {acc} "
            f"ELSE (1 + {t}) * ln(1 + {t}) + (1 - {t}) * ln(1 - {t}) END)")


def _alignment_select() -> str:
    u = [f"u[{i}]" for i in range(1, 7)]
    v = [f"coalesce(pv.v, [0.0, 0.0, 0.0, 0.0, 0.0, 0.0])[{i}]" for i in range(1, 7)]
    dot = _sum([f"{a} * {b}" for a, b in zip(u, v)])
    nu = f"sqrt({_sum([f'{a} * {a}' for a in u])})"
    nv = f"sqrt({_sum([f'{b} * {b}' for b in v])})"
    dn = [f"({a} / {nu} - {b} / {nv})" for a, b in zip(u, v)]
    cos = f"CASE WHEN {nu} > 0 AND {nv} > 0 THEN {_sum([f'{d} * {d}' for d in dn])} / 2 END"
    euc = f"sqrt({_sum([f'({a} - {b}) * ({a} - {b})' for a, b in zip(u, v)])})"
    pu = [f"(abs({a}) + 1e-10)" for a in u]
    pv = [f"(abs({b}) + 1e-10)" for b in v]
    su, sv = _sum(pu), _sum(pv)
    p = [f"({a} / {su})" for a in pu]
    q = [f"({b} / {sv})" for b in pv]
    js = f"sqrt({_sum([f'(({a} + {b}) / 2 * {_js_g(f"(({a} - {b}) / ({a} + {b}))")})' for a, b in zip(p, q)])} / 2)"
    su_s = "list_sort(u)"
    sv_s = "list_sort(coalesce(pv.v, [0.0, 0.0, 0.0, 0.0, 0.0, 0.0]))"
    ws = _sum([f"abs({su_s}[{i}] - {sv_s}[{i}])" for i in range(1, 7)]) + " / 6"
    return (f"p.population, {cos} AS cosine_distance, {euc} AS euclidean_distance, "
            f"{js} AS jensen_shannon_divergence, {ws} AS wasserstein_distance")


POPULATION_ALIGNMENT = f"""
SELECT {_alignment_select()}
FROM (SELECT population FROM inf GROUP BY population HAVING count(*) >= 3) p
LEFT JOIN pvec pv USING (population), rvec"""

STRUCTURAL_CLASSES = f"""
SELECT a.population, pr.instability_index, a.cosine_distance,
       CASE WHEN a.cosine_distance < 0.10 THEN 'generalized_churn_structure'
            WHEN a.cosine_distance < 0.25 THEN 'membership_conditioned_structure'
            WHEN pr.instability_index < 0.05 THEN 'retained_suppression_structure'
            ELSE 'diagnostic_only_structure' END AS structural_classification
FROM ({POPULATION_ALIGNMENT}) a LEFT JOIN ({POPULATION_PROFILES_BODY}) pr USING (population)"""

# ------------------------------------------------------------------ plot data

_SF = ["points_in_wallet", "avg_transaction_value", "avg_frequency_login_days", "value_density"]
HISTOGRAM = f"""
SELECT g.feature, g.bin, g.lo + g.bin * ((g.hi - g.lo) / 30) AS bin_start,
       g.lo + (g.bin + 1) * ((g.hi - g.lo) / 30) AS bin_end, coalesce(c.n, 0) AS count
FROM (SELECT feature, lo, hi, CAST(unnest(range(0, 30)) AS INTEGER) AS bin FROM
        (SELECT feature, CASE WHEN max(x) = min(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
                CASE WHEN max(x) = min(x) THEN max(x) + 0.5 ELSE max(x) END AS hi
         FROM (UNPIVOT (SELECT {', '.join(_SF)} FROM st) ON {', '.join(_SF)} INTO NAME feature VALUE x) GROUP BY feature)) g
LEFT JOIN (SELECT feature, CAST(least(floor((x - lo) * 30 / (hi - lo)), 29) AS INTEGER) AS bin, count(*) AS n
           FROM (UNPIVOT (SELECT {', '.join(_SF)} FROM st) ON {', '.join(_SF)} INTO NAME feature VALUE x)
           JOIN (SELECT feature, CASE WHEN max(x) = min(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
                        CASE WHEN max(x) = min(x) THEN max(x) + 0.5 ELSE max(x) END AS hi
                 FROM (UNPIVOT (SELECT {', '.join(_SF)} FROM st) ON {', '.join(_SF)} INTO NAME feature VALUE x)
                 GROUP BY feature) USING (feature)
           GROUP BY 1, 2) c ON c.feature = g.feature AND c.bin = g.bin"""

BOX_STATS = """
SELECT behavioral_archetype, q1, median, q3,
       min(tenure_days) FILTER (WHERE tenure_days >= lo AND tenure_days <= hi) AS lower_whisker,
       max(tenure_days) FILTER (WHERE tenure_days >= lo AND tenure_days <= hi) AS upper_whisker,
       count(*) FILTER (WHERE tenure_days IS NOT NULL AND NOT (tenure_days >= lo AND tenure_days <= hi)) AS outlier_count
FROM arc JOIN (SELECT behavioral_archetype, q1, median, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
               FROM (SELECT behavioral_archetype, quantile_cont(tenure_days, 0.25) AS q1,
                            quantile_cont(tenure_days, 0.5) AS median, quantile_cont(tenure_days, 0.75) AS q3
                     FROM arc GROUP BY 1)) USING (behavioral_archetype)
GROUP BY behavioral_archetype, q1, median, q3"""


_LABELS = ["consistent", "high", "inactive", "irregular", "low", "mid", "moderate"]
INTERACTION_MATRIX = "SELECT feature_pair, state_a, " + ", ".join(
    f"max(CASE WHEN state_b = '{x}' THEN joint_prevalence_percentage END) AS {x}" for x in _LABELS) + \
    " FROM dens GROUP BY feature_pair, state_a"

STATE_MAPPING = """
SELECT feature, feature || '_state' AS state_column,
       CASE feature WHEN 'avg_frequency_login_days' THEN 'inactive,irregular,consistent'
                    WHEN 'value_density' THEN 'low,moderate,high' ELSE 'low,mid,high' END AS labels,
       CAST(3 AS INTEGER) AS rules, low_threshold, high_threshold FROM thr"""

_Z = [f"CASE WHEN stddev_pop({c}) OVER () = 0 THEN 0.0 ELSE ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () END"
      for c in _VEC]
SILHOUETTE = f"""
SELECT avg(CASE WHEN n = 1 THEN 0.0 WHEN greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END)
         AS silhouette_score
FROM (SELECT r.id, max(CASE WHEN k.population = r.population THEN k.n END) AS n,
             max(CASE WHEN k.population = r.population THEN d * k.n / nullif(k.n - 1, 0) END) AS a,
             min(CASE WHEN k.population <> r.population THEN d END) AS b
      FROM (SELECT z.id, z.population AS rp, k2.population AS kp, avg({' + '.join(f'(z.z{i} - k2.z{i}) * (z.z{i} - k2.z{i})' for i in range(6))}) AS d
            FROM z JOIN z k2 ON true GROUP BY 1, 2, 3) p
      JOIN z r ON r.id = p.id
      JOIN (SELECT population, count(*) AS n FROM z GROUP BY population) k ON k.population = p.kp
      GROUP BY r.id)
HAVING count(*) > 0 AND (SELECT count(DISTINCT population) FROM z) > 1"""
SCALED = INF + f""",
z AS (SELECT row_number() OVER () AS id, population, {', '.join(f'{e} AS z{i}' for i, e in enumerate(_Z))}
      FROM clean WHERE population IN (SELECT population FROM inf GROUP BY population HAVING count(*) >= 5))"""


# Actions per role.
_ACTIONS = {"STRUCTURAL": "segmentation anchor", "EXPOSURE_SENSITIVE": "rate conversion,log transform if skewed",
            "EPISTEMIC": "isolate or restrict usage", "LOW_SIGNAL": "candidate for elimination"}
FEATURE_REPORT = f"""
SELECT r.feature, r.type,
       concat_ws(',', CASE WHEN r.type = 'Numerical' AND abs(p.skewness) > 1 THEN 'HIGH_SKEW' END,
                 CASE WHEN r.type = 'Numerical' AND r.role = 'EXPOSURE_SENSITIVE' THEN 'ACCUMULATIVE_PATTERN' END,
                 CASE WHEN r.role = 'EPISTEMIC' THEN 'POST_OUTCOME_LEAKAGE_RISK' END,
                 CASE r.priority WHEN 'HIGH' THEN 'STRONG_CHURN_SEPARATION' WHEN 'LOW' THEN 'WEAK_CHURN_SIGNAL' END)
         AS flags,
       coalesce(b.pattern, 'FLAT') AS pattern, p.mean, p.median, p.std, p.skewness, p.kurtosis,
       CASE WHEN p.mean <> 0 THEN p.std / p.mean END AS cv, c.corr_churn, c.corr_exposure_proxy,
       k.n_values, k.n_rows, {', '.join(f'br.{x.lower()}_{c}' for x in ('LOW', 'MEDIUM', 'HIGH') for c in ('count', 'churn_rate'))},
       CASE r.role {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _ACTIONS.items())} END AS actions
FROM ({PROFILE_REGISTER}) r LEFT JOIN np p ON p.feature = r.feature
LEFT JOIN ({CORR_PROFILE}) c ON c.feature = r.feature
LEFT JOIN ({BRACKET_PATTERN}) b ON b.feature = r.feature
LEFT JOIN (SELECT feature, count(DISTINCT value) AS n_values, count(*) AS n_rows FROM cl GROUP BY feature) k
  ON k.feature = r.feature
LEFT JOIN (SELECT feature, {', '.join(f"max({c}) FILTER (WHERE bracket = '{x}') AS {x.lower()}_{c}"
                                      for x in ('LOW', 'MEDIUM', 'HIGH') for c in ('count', 'churn_rate'))}
           FROM (SELECT feature, bracket, count, churn_rate FROM nbs UNION ALL
                 SELECT feature, bracket, count, churn_rate FROM cbs) GROUP BY feature) br ON br.feature = r.feature"""

SCALED_VECTORS = f"SELECT population, {', '.join(f'round(z{i}, 6) AS {c}_z' for i, c in enumerate(_VEC))} FROM z"

_REF = "population IN ('building_churned', 'household_churned')"
REFERENCE_COVARIANCE = _union([
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, avg({a} * {b} - {a} * mb - ma * {b} + ma * mb) AS covariance "
    f"FROM clean, (SELECT avg({a}) AS ma, avg({b}) AS mb FROM clean WHERE {_REF}) WHERE {_REF}"
    for i, a in enumerate(_VEC) for b in _VEC[i:]])

# Weights of the integrity score.
_WEIGHTS = {"cosine_distance": 0.30, "euclidean_distance": 0.15, "mahalanobis_distance": 0.15,
            "instability_index": 0.25, "jensen_shannon_divergence": 0.10, "wasserstein_distance": 0.05}
INTEGRITY_SCORES = f"""
SELECT population, structural_integrity_score,
       (SELECT count(*) FROM sc o WHERE o.structural_integrity_score > sc.structural_integrity_score) + 1
         + ((SELECT count(*) FROM sc o WHERE o.structural_integrity_score = sc.structural_integrity_score) - 1) / 2.0
         AS structural_rank,
       CASE WHEN structural_integrity_score > 0.75 THEN 'stable_retention_core'
            WHEN cosine_distance < 0.10 AND instability_index > 0.08 THEN 'latent_churn_equivalent'
            WHEN instability_index < 0.05 AND cosine_distance > 0.25 THEN 'behaviorally_inconsistent_retention'
            WHEN cosine_distance > 0.20 AND instability_index > 0.08 THEN 'high_instability_low_divergence'
            ELSE 'diagnostic_noise_group' END AS final_archetype, {', '.join(f'{c}_norm' for c in _WEIGHTS)}
FROM sc"""
_SUMMARY = f"""
SELECT a.population, {', '.join(f'coalesce({c}, 0.0) AS {c}' for c in _WEIGHTS if c != 'mahalanobis_distance')},
       0.0::DOUBLE AS mahalanobis_distance
FROM ({POPULATION_ALIGNMENT}) a LEFT JOIN
     (SELECT population, instability_index FROM ({POPULATION_PROFILES_BODY})) p ON p.population = a.population"""
_NORM = ", ".join(f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.0 ELSE ({c} - min({c}) OVER ()) / "
                  f"(max({c}) OVER () - min({c}) OVER ()) END AS {c}_norm" for c in _WEIGHTS)
SCORED = INF + f""",
sm AS ({_SUMMARY}),
sn AS (SELECT *, {_NORM} FROM sm),
sc AS (SELECT *, {' + '.join(f'{w} * (1 - {c}_norm)' for c, w in _WEIGHTS.items())} AS structural_integrity_score
       FROM sn)"""


# ------------------------------------------------------------------ neighbours, samples, curves, logs

def _nested(body: str) -> str:
    """A statement with its own common table expressions as one that can follow others."""
    return f"SELECT * FROM ({body}\n)"


def _hash52(*parts: str) -> str:
    """52 bits of the MD5 digest of the parts joined by '|'."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13) AS BIGINT)"


def _digamma(n: str) -> str:
    z = f"({n} + 8.0)"
    return (f"(ln({z}) - 1 / (2 * {z}) - 1 / (12 * power({z}, 2)) + 1 / (120 * power({z}, 4)) - 1 / (252 * power({z}, 6))"
            f" + 1 / (240 * power({z}, 8)) - 1 / (132 * power({z}, 10)) - "
            + " - ".join(f"1 / ({n} + {j}.0)" for j in range(8)) + ")")


def _neighbour_information(enc: str, k: int = 3) -> str:
    """Nearest-neighbour mutual information of a relation (customer_id, y, feature, x), windows and a counting join."""
    cand = ", ".join(
        f"CASE WHEN {fn}(x, {j}) OVER w IS NOT NULL THEN {{'d': {sign} * ({fn}(x, {j}) OVER w - x), "
        f"'e': {sign} * ({fn}(u, {j}) OVER w - u), 'side': {sign}, 'nx': {fn}(x, {j}) OVER w, 'nu': {fn}(u, {j}) OVER w}} END"
        for j in range(1, k + 1) for fn, sign in (("lag", -1), ("lead", 1)))
    return f"""
WITH e AS (SELECT customer_id, y, feature, coalesce(x, 0.0) AS x, {_hash52('feature', 'CAST(customer_id AS VARCHAR)')} AS u
           FROM ({enc})),
p0 AS (SELECT e.*, count(*) OVER (PARTITION BY feature, y) AS size FROM e),
p AS (SELECT * FROM p0 WHERE size > 1),
c AS (SELECT *, least({k}, size - 1) AS kk, list_sort(list_filter([{cand}], lambda s: s IS NOT NULL)) AS near
      FROM p WINDOW w AS (PARTITION BY feature, y ORDER BY x, u)),
b AS (SELECT *, near[kk].side AS side, near[kk].nx AS nx, near[kk].nu AS nu FROM c),
r AS (SELECT *, CASE WHEN side > 0 THEN 2 * x - nx ELSE nx END AS lx, CASE WHEN side > 0 THEN 2 * u - nu ELSE nu END AS lu,
             CASE WHEN side > 0 THEN nx ELSE 2 * x - nx END AS rx, CASE WHEN side > 0 THEN nu ELSE 2 * u - nu END AS ru FROM b),
m AS (SELECT r.feature, r.customer_id, any_value(r.kk) AS kk, any_value(r.size) AS size, count(*) AS m
      FROM r JOIN p q ON q.feature = r.feature AND (q.x > lx OR (q.x = lx AND q.u > lu))
                     AND (q.x < rx OR (q.x = rx AND q.u < ru)) GROUP BY r.feature, r.customer_id)
SELECT feature, round(greatest({_digamma('count(*)')} + avg({_digamma('kk')}) - avg({_digamma('size')})
                               - avg({_digamma('m')}), 0.0), 9) AS mutual_info_score
FROM m GROUP BY feature"""


MI_NEIGHBOURS = _nested(_neighbour_information(f"""
  SELECT customer_id, churn AS y, v.feature || '_' || v.value AS feature, CASE WHEN t.value = v.value THEN 1.0 ELSE 0.0 END AS x
  FROM (UNPIVOT (SELECT customer_id, churn, {', '.join(f'coalesce(CAST({c} AS VARCHAR), chr(0)) AS {c}' for c in _MI_STR)} FROM mart)
        ON {', '.join(_MI_STR)} INTO NAME feature VALUE value) t
  JOIN (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) AS rn
        FROM (SELECT DISTINCT feature, value FROM l WHERE feature IN (SELECT feature FROM card))) v
    ON t.feature = v.feature AND v.rn > 1
  UNION ALL
  SELECT customer_id, churn, feature, x
  FROM (UNPIVOT (SELECT customer_id, churn, {', '.join(f'coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}' for c in _MI_NUM[1:])} FROM mart)
        ON {', '.join(_MI_NUM[1:])} INTO NAME feature VALUE x) WHERE feature IN (SELECT feature FROM card)"""))

MI_NUMERIC = _nested(_neighbour_information(f"""
  SELECT customer_id, churn AS y, feature, x
  FROM (UNPIVOT (SELECT customer_id, churn, {', '.join(f'coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}' for c in _NUMERIC)} FROM mart)
        ON {', '.join(_NUMERIC)} INTO NAME feature VALUE x)"""))

KEYED = INF + f""",
zk AS (SELECT customer_id, population, {', '.join(f'{e} AS z{i}' for i, e in enumerate(_Z))}
       FROM clean WHERE population IN (SELECT population FROM inf GROUP BY population HAVING count(*) >= 5)),
zs AS (SELECT *, row_number() OVER (PARTITION BY population ORDER BY {_hash52('CAST(customer_id AS VARCHAR)')}, customer_id) AS rn
       FROM zk)"""


def _silhouettes(chosen: str) -> str:
    """customer_id, population, s of the chosen rows, distances to all rows."""
    square = " + ".join(f"power(q.z{i} - r.z{i}, 2)" for i in range(6))
    return f"""
SELECT customer_id, population, CASE WHEN n = 1 THEN 0.0 WHEN greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END AS s
FROM (SELECT customer_id, own AS population, max(CASE WHEN own = pop THEN n END) AS n,
             max(CASE WHEN own = pop THEN d / nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> pop THEN d / n END) AS b
      FROM (SELECT q.customer_id, q.population AS own, r.population AS pop, count(*) AS n, sum(sqrt({square})) AS d
            FROM ({chosen}) q JOIN zk r ON true GROUP BY 1, 2, 3) GROUP BY 1, 2) WHERE b IS NOT NULL"""


SILHOUETTE_EUCLIDEAN = f"SELECT avg(s) AS silhouette_score FROM ({_silhouettes('SELECT * FROM zk')}) HAVING count(*) > 0"
SILHOUETTE_SAMPLE = _nested(f"""
WITH s AS ({_silhouettes('SELECT * FROM zs WHERE rn <= 50')}),
g AS (SELECT s.population, any_value(k.n) AS n, count(*) AS m, avg(s) AS score,
             coalesce(var_samp(s), 0.0) / count(*) * (1 - count(*) / any_value(k.n)) AS e
      FROM s JOIN (SELECT population, count(*) AS n FROM zk GROUP BY population) k USING (population) GROUP BY s.population)
SELECT population, n AS rows, m AS sampled, score AS silhouette_score, 1.96 * sqrt(e) AS error_bound FROM g
UNION ALL
SELECT NULL, CAST(sum(n) AS BIGINT), CAST(sum(m) AS BIGINT), sum(n / t * score), 1.96 * sqrt(sum(n / t * n / t * e))
FROM g, (SELECT CAST(sum(n) AS DOUBLE) AS t FROM g) HAVING count(*) > 0""")


def scatter_sample(x: str, y: str, k: int = 100) -> str:
    return f"""
SELECT customer_id, behavioral_archetype, {x}, {y} FROM (
  SELECT *, row_number() OVER (PARTITION BY behavioral_archetype
                               ORDER BY {_hash52('CAST(customer_id AS VARCHAR)')}, customer_id) AS rn FROM arc)
WHERE rn <= {k}"""


STATE_RULES = "\nUNION ALL\n".join(f"""
SELECT feature, feature || '_state' AS state_column, CAST({n} AS INTEGER) AS position, {rule} AS rule,
       CASE feature WHEN 'avg_frequency_login_days' THEN '{login}' WHEN 'value_density' THEN '{density}' ELSE '{other}' END AS label
FROM thr""" for n, rule, login, density, other in (
    (1, "'<= ' || CAST(low_threshold AS VARCHAR)", "inactive", "low", "low"),
    (2, "'> ' || CAST(low_threshold AS VARCHAR) || ' and <= ' || CAST(high_threshold AS VARCHAR)", "irregular", "moderate", "mid"),
    (3, "'> ' || CAST(high_threshold AS VARCHAR)", "consistent", "high", "high")))

DENSITY_CURVE = _nested(f"""
WITH v AS (SELECT * FROM (UNPIVOT (SELECT {', '.join(_SF)} FROM st) ON {', '.join(_SF)} INTO NAME feature VALUE x)
           WHERE NOT isnan(x)),
f AS (SELECT feature, min(x) AS lo, max(x) AS hi, count(*) AS n, stddev_samp(x) * power(count(*), -0.2) AS bw FROM v
      GROUP BY feature HAVING count(*) > 1 AND max(x) > min(x)),
a AS (SELECT v.feature, (x - lo) / ((hi - lo) / 199) AS pos FROM v JOIN f USING (feature)),
w AS (SELECT feature, g, sum(w) AS w FROM (
        SELECT feature, least(floor(pos), 198) AS g, 1 - (pos - least(floor(pos), 198)) AS w FROM a
        UNION ALL SELECT feature, least(floor(pos), 198) + 1, pos - least(floor(pos), 198) FROM a) GROUP BY feature, g),
d AS (SELECT f.feature, p.point, any_value(lo) AS lo, any_value(hi) AS hi, any_value(n) AS n,
             sum(w * exp(-power((p.point - g) * ((hi - lo) / 199) / bw, 2) / 2)) / (any_value(n) * any_value(bw) * sqrt(2 * pi()))
               AS density
      FROM f JOIN w USING (feature) JOIN (SELECT unnest(range(0, 200)) AS point) p ON true GROUP BY f.feature, p.point)
SELECT feature, CAST(point AS INTEGER) AS point, lo + point * ((hi - lo) / 199) AS x, density,
       density * n * (hi - lo) / 30 AS count_scale FROM d""")

CATEGORY_BRACKETS = "SELECT mart.customer_id, " + ", ".join(
    f"(SELECT bracket FROM rb WHERE rb.feature = '{c}' AND rb.value = mart.{c}) AS {c}_bracket" for c in _CATEG) + " FROM mart"


def _log_row(original, engineered, transformation, trigger, filled="0", clipped="0"):
    return f"""
SELECT '{original}' AS original_feature, '{engineered}' AS engineered_feature, '{transformation}' AS transformation,
       '{trigger}' AS trigger, (SELECT count(*) FROM cohort) AS rows, CAST(0 AS BIGINT) AS coerced,
       CAST((SELECT {filled} FROM cohort) AS BIGINT) AS filled, CAST(({clipped}) AS BIGINT) AS clipped,
       (SELECT count(*) FROM eng WHERE {engineered} IS NULL) AS undefined"""


def _missing(*cols):
    return " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in cols)


_TXN, _TIME, _POINTS, _LOGIN, _LAST = ("avg_transaction_value", "avg_time_spent", "points_in_wallet",
                                       "avg_frequency_login_days", "days_since_last_login")
TRANSFORMATION_LOG = "\nUNION ALL".join([
    _log_row(_POINTS, "points_per_day", "rate_conversion", "TENURE_CORRELATED", _missing(_POINTS)),
    _log_row(f"{_TXN} + {_TIME}", "value_density", "ratio_metric", "Behavioral Intensity", _missing(_TXN, _TIME)),
    _log_row(f"{_POINTS} + {_TIME}", "engagement_efficiency", "ratio_metric", "Behavioral Efficiency", _missing(_POINTS, _TIME)),
    _log_row(_TXN, "log_avg_txn", "clip + log1p", "HIGH_SKEW", _missing(_TXN),
             "SELECT count(*) FROM fe1, caps WHERE avg_transaction_value > txn_cap"),
    _log_row("points_per_day", "log_points", "clip + log1p", "HIGH_SKEW", "0 * count(*)",
             "SELECT count(*) FROM fe1, caps WHERE points_per_day > points_cap"),
    _log_row(_LAST, "recency_score", "inverse_decay", "Recency Signal", _missing(_LAST), "SELECT count(*) FROM fe0 WHERE d0 < 0"),
    _log_row(_LOGIN, "logins_per_day", "inverse_frequency", "Activity Rate", _missing(_LOGIN)),
    _log_row(_TIME, "time_per_day", "rate_conversion", "TENURE_CORRELATED", _missing(_TIME)),
    _log_row("points_per_day + time_per_day", "points_time_interaction", "interaction", "Signal Amplification", "0 * count(*)"),
    *[f"""
SELECT '{c}', NULL, 'dropped', NULL, (SELECT count({c}) FROM cohort), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT),
       CAST(NULL AS BIGINT)""" for c in ("complaint_status", "region_category", "feedback")]])


COLUMN_GUARD = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, {'true' if there else 'false'} AS present, {f'count({c})' if there else 'CAST(0 * count(*) AS BIGINT)'}"
    f" AS value_count FROM arc" for c, there in (
        ("tenure_days", True), ("recency_score", True), ("event_value_avg", True), ("days_since_last_complaint", False)))

_ENG_NUMERIC = ["points_in_wallet", "avg_transaction_value", "avg_time_spent", "avg_frequency_login_days",
                "days_since_last_login", "event_value_avg", "tenure_days", "points_per_day", "value_density",
                "engagement_efficiency", "log_avg_txn", "log_points", "recency_score", "logins_per_day", "time_per_day",
                *[_dummy(r) for r in REGIONS], "points_time_interaction", *[f"{_dummy(r)}_x_value" for r in REGIONS]]
VARIATION_TABLE = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, avg({c}) AS mean, CASE WHEN avg({c}) <> 0 THEN stddev_samp({c}) / avg({c}) END "
    f"AS coefficient_variation FROM eng" for c in _ENG_NUMERIC)

PROGRESSION_TABLE = f"""
SELECT l.* EXCLUDE (median_engagement_efficiency), l.median_engagement_efficiency AS median_engagement_efficiency_lifecycle,
       d.* EXCLUDE (behavioral_archetype, median_engagement_efficiency),
       d.median_engagement_efficiency AS median_engagement_efficiency_decay, i.overall_instability_score
FROM ({LIFECYCLE_POSITIONING}) l LEFT JOIN decay d USING (behavioral_archetype)
LEFT JOIN ({INSTABILITY_PROFILES}) i USING (behavioral_archetype)"""

COMPARISON_TABLE = f"""
SELECT p.population, p.population_size, p.instability_index, a.* EXCLUDE (population), c.structural_classification
FROM ({POPULATION_PROFILES_BODY}) p LEFT JOIN ({POPULATION_ALIGNMENT}) a USING (population)
LEFT JOIN ({STRUCTURAL_CLASSES}) c USING (population)"""
