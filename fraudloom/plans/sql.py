"""DuckDB SQL of the catalogue's queries, written from the rules' definitions."""

from __future__ import annotations

AS_OF = (1_704_844_800_000_000, 1_705_708_800_000_000, 1_706_659_200_000_000)
HORIZONS = {"1m": 60, "5m": 300, "1h": 3_600, "24h": 86_400, "7d": 604_800, "30d": 2_592_000}

TXN = """txn AS (
  SELECT event_id AS txn_id, ts AS occurred_at, epoch_us(ts) AS us, user_id, k, CAST(round(value * 100) AS BIGINT) AS amount_minor,
    CAST(400000 + user_id % 10 AS VARCHAR) AS bin, CAST(400000 + user_id % 10 AS VARCHAR) || '****' || right(lpad(CAST(user_id AS VARCHAR), 10, '0'), 4) AS card_token,
    'dev-' || (k % 20) AS device, '10.0.0.' || k AS ip, 'mrc-' || (k % 10) AS merchant,
    CASE k % 10 WHEN 7 THEN 7995 WHEN 6 THEN 6051 WHEN 4 THEN 4829 WHEN 2 THEN 6211 ELSE 5411 END AS mcc,
    CASE k % 7 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS avs_match, CASE k % 11 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS cvv_match,
    event_type = 'error' AS declined, CASE WHEN k % 5 <> 0 THEN CAST((k * 37) % 121 - 60 AS DOUBLE) END AS lat, CASE WHEN k % 5 <> 0 THEN CAST((k * 53) % 301 - 150 AS DOUBLE) END AS lon
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events))"""
AML = """aml AS (
  SELECT o_custkey AS acct, o_orderkey AS seq, CAST(round(o_totalprice * 100) AS BIGINT) AS amount_minor, CASE WHEN o_orderstatus = 'P' THEN 'out' ELSE 'in' END AS direction,
    'cp-' || (o_orderkey % 3) AS counterparty, 'g' || (o_orderkey % 5) AS geography, o_orderdate AS occurred_at, epoch_us(o_orderdate) AS us FROM orders)"""


def edges() -> str:
    return f"{TXN}, e AS (SELECT 'n' || user_id AS src, 'n' || k AS dst, amount_minor, us AS time, txn_id AS seq FROM txn)"


def frame(key: str, secs: int, cut: bool = True) -> str:
    return f"(PARTITION BY {key} ORDER BY us RANGE BETWEEN {secs * 1_000_000 + (999_999 if cut else 0)} PRECEDING AND CURRENT ROW)"


def windows(key: str, horizons=HORIZONS, sq: bool = True) -> str:
    out = []
    for h, s in horizons.items():
        f = frame(key, s)
        out += [f"count(*) OVER {f} AS cnt_{h}", f"CAST(sum(amount_minor) OVER {f} AS BIGINT) AS sum_{h}", f"CAST(coalesce(sum(CAST(declined AS INT)) OVER {f}, 0) AS BIGINT) AS dec_{h}", f"len(list_distinct(list(device) OVER {f})) AS dev_{h}"]
        if sq:
            out.append(f"sum(CAST(amount_minor AS HUGEINT) * amount_minor) OVER {f} AS sq_{h}")
    return ", ".join(out)


WINDOWS_SIX = f"WITH {TXN}, w AS (SELECT txn_id, {windows('card_token')} FROM txn) SELECT txn_id, " + ", ".join(
    f"CAST({p}_{h} AS {'VARCHAR' if p == 'sq' else 'BIGINT'}) AS {p}_{h}" for h in HORIZONS for p in ("cnt", "sum", "sq", "dev", "dec")) + " FROM w"
WINDOWS_ENTITY = f"""WITH {TXN}, f AS (
  SELECT *, unnest(['card:' || card_token, 'bin:' || bin, 'device:' || device, 'ip:' || ip, 'merchant:' || merchant]) AS entity FROM txn),
w AS (SELECT entity, {windows('entity', {'1h': 3600, '24h': 86400}, False)} FROM f)
SELECT entity, CAST(sum(cnt_1h) AS BIGINT) AS cnt_1h, CAST(sum(cnt_24h) AS BIGINT) AS cnt_24h, CAST(sum(dev_24h) AS BIGINT) AS dev_24h, CAST(sum(sum_24h) AS BIGINT) AS sum_24h FROM w GROUP BY entity"""
_pit = []
for _h in ("24h", "7d", "30d"):
    _on = f"(a.as_of_us - t.us) // 1000000 <= {HORIZONS[_h]}"
    _pit += [f"CAST(count(*) FILTER (WHERE {_on}) AS BIGINT) AS cnt_{_h}", f"CAST(coalesce(sum(amount_minor) FILTER (WHERE {_on}), 0) AS BIGINT) AS sum_{_h}",
             f"CAST(count(DISTINCT device) FILTER (WHERE {_on}) AS BIGINT) AS dev_{_h}", f"CAST(count(*) FILTER (WHERE {_on} AND declined) AS BIGINT) AS dec_{_h}"]
POINT_IN_TIME = f"""WITH {TXN}, a AS (SELECT DISTINCT card_token, x AS as_of_us FROM txn, (SELECT unnest([{', '.join(map(str, AS_OF))}]) AS x)),
j AS (SELECT a.card_token, a.as_of_us, {', '.join(_pit)} FROM a JOIN txn t ON t.card_token = a.card_token AND t.us <= a.as_of_us GROUP BY ALL)
SELECT a.card_token, a.as_of_us, {', '.join(f'coalesce({p}_{h}, 0) AS {p}_{h}' for h in ('24h', '7d', '30d') for p in ('cnt', 'sum', 'dev', 'dec'))} FROM a LEFT JOIN j USING (card_token, as_of_us)"""

_LAG = f"""{TXN}, w0 AS (SELECT *, {windows('card_token')} FROM txn),
w AS (SELECT txn_id, us, k, card_token, amount_minor, mcc, device, merchant, declined, {', '.join(f'lag({p}_{h}) OVER o AS {p}_{h}' for h in HORIZONS for p in ('cnt', 'sum', 'sq', 'dev', 'dec'))}
  FROM w0 WINDOW o AS (PARTITION BY card_token ORDER BY us, txn_id)),
m AS (SELECT *, CASE WHEN coalesce(cnt_30d, 0) > 0 THEN CAST(sum_30d AS DOUBLE) / cnt_30d ELSE 0 END AS mean30,
  CASE WHEN coalesce(cnt_30d, 0) >= 2 THEN sqrt(greatest(0, CAST(sq_30d AS DOUBLE) / cnt_30d - (CAST(sum_30d AS DOUBLE) / cnt_30d) * (CAST(sum_30d AS DOUBLE) / cnt_30d))) ELSE 0 END AS std30 FROM w),
f AS (SELECT *, CASE WHEN mean30 > 0 THEN amount_minor / mean30 ELSE 1 END AS amount_ratio, CASE WHEN std30 > 0 THEN (amount_minor - mean30) / std30 ELSE 0 END AS amount_zscore FROM m)"""
LAGGED = f"WITH {_LAG} SELECT txn_id, cnt_24h, cnt_30d, sum_30d, round(amount_ratio, 6) AS amount_ratio, round(amount_zscore, 6) AS amount_zscore, CAST(coalesce(cnt_30d, 0) AS BIGINT) AS velocity_count FROM f"
_FEATURES = """CAST(coalesce(cnt_5m, 0) AS FLOAT) AS f_velocity_5m, CAST(coalesce(cnt_1h, 0) AS FLOAT) AS f_velocity_1h, CAST(coalesce(cnt_24h, 0) AS FLOAT) AS f_velocity_24h, CAST(amount_ratio AS FLOAT) AS f_amount_ratio,
  CAST(amount_zscore AS FLOAT) AS f_amount_zscore, CAST(coalesce(dev_24h, 0) AS FLOAT) AS f_device_spread, CAST(CASE WHEN coalesce(cnt_1h, 0) > 0 THEN CAST(dec_1h AS DOUBLE) / cnt_1h ELSE 0 END AS FLOAT) AS f_decline_rate,
  CAST(mcc IN (7995, 4829, 6051) AS FLOAT) AS f_high_risk_mcc"""
_NAMES = ["velocity_5m", "velocity_1h", "velocity_24h", "amount_ratio", "amount_zscore", "device_spread", "decline_rate", "high_risk_mcc"]
VECTOR = f"WITH {_LAG}, v AS (SELECT txn_id, {_FEATURES} FROM f) SELECT txn_id, " + ", ".join(f"round(CAST(f_{n} AS DOUBLE), 3) AS f_{n}" for n in _NAMES) + " FROM v"

_STATELESS = """list_filter([
  CASE WHEN bin = '400003' THEN 'BLOCKLIST_BIN' END, CASE WHEN card_token = '400005****0015' THEN 'BLOCKLIST_PAN' END, CASE WHEN device = 'dev-7' THEN 'BLOCKLIST_DEVICE' END, CASE WHEN ip = '10.0.0.13' THEN 'BLOCKLIST_IP' END,
  CASE WHEN merchant = 'mrc-9' THEN 'BLOCKLIST_MERCHANT' END, CASE WHEN mcc <> 5411 THEN 'MCC_HIGH_RISK' END, CASE WHEN avs_match = false THEN 'AVS_MISMATCH' END, CASE WHEN cvv_match = false THEN 'CVV_MISMATCH' END], lambda x: x IS NOT NULL)"""
_SOFT = "('MCC_HIGH_RISK', 'AVS_MISMATCH', 'CVV_MISMATCH', 'AMOUNT_ANOMALY')"
STATELESS = f"""WITH {TXN}, h AS (SELECT txn_id, {_STATELESS} AS c FROM txn)
SELECT txn_id, array_to_string(c, ',') AS codes, len(list_filter(c, lambda x: x NOT IN {_SOFT})) > 0 AS hard, CAST(len(list_filter(c, lambda x: x IN {_SOFT})) AS BIGINT) AS soft FROM h"""
DENY_JOIN = f"WITH {TXN}, l AS (SELECT DISTINCT 'mrc-' || (s_suppkey % 5) AS m FROM supplier) SELECT merchant, merchant IN (SELECT m FROM l) AS denied, count(*) AS n FROM txn GROUP BY ALL"


def _low(low: int, secs: int) -> str:
    return f"count(*) FILTER (WHERE amount_minor <= {low}) OVER {frame('device', secs, False)}"


CARD_TESTING = f"WITH {TXN}, c AS (SELECT *, {_low(1500, 86400)} AS n FROM txn) SELECT txn_id, device FROM c WHERE amount_minor <= 1500 AND n > 6"
CARD_TESTING_DEFAULT = f"WITH {TXN}, c AS (SELECT *, {_low(200, 300)} AS n FROM txn) SELECT amount_minor <= 200 AND n > 5 AS fires, count(*) AS n FROM c GROUP BY 1"
_BINS = f"len(list_distinct(list(card_token) OVER {frame('bin', 21600, False)}))"
BIN_ATTACK = f"WITH {TXN}, c AS (SELECT *, {_BINS} AS d FROM txn) SELECT txn_id, bin FROM c WHERE d > 8"
DECLINE_RETRY = f"WITH {TXN}, c AS (SELECT *, sum(CAST(declined AS INT)) OVER {frame('card_token', 604800, False)} - CAST(declined AS INT) AS d FROM txn) SELECT txn_id, card_token FROM c WHERE d > 5"
TRAVEL = f"""WITH {TXN}, g AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(us) OVER w AS pus FROM txn WHERE lat IS NOT NULL WINDOW w AS (PARTITION BY card_token ORDER BY us, txn_id)),
s AS (SELECT txn_id, 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians(lat) - radians(plat)) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2)))) / ((us - pus) / 3.6e9) AS kmh FROM g WHERE us > pus)
SELECT txn_id, round(kmh, 3) AS kmh, kmh > 1000 AS impossible FROM s WHERE kmh > 300"""
_HISTORY = "count(amount_minor) OVER h AS prior_n, avg(amount_minor) OVER h AS prior_mean"
_HISTORY_W = "WINDOW h AS (PARTITION BY card_token ORDER BY us, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
ANOMALY = f"""WITH {TXN}, h0 AS (SELECT txn_id, amount_minor, {_HISTORY} FROM txn {_HISTORY_W})
SELECT txn_id, prior_n, round(prior_mean, 4) AS prior_mean, amount_minor > 10 * prior_mean AS at_default FROM h0 WHERE prior_n >= 5 AND amount_minor > 4 * prior_mean"""


def _mix(source: str = "txn") -> str:
    return f"""x0 AS (SELECT *, {_low(1500, 86400)} AS low_n, {_BINS} AS bin_n, {_HISTORY} FROM {source} {_HISTORY_W}),
x AS (SELECT *, {_STATELESS} || list_filter([CASE WHEN amount_minor <= 1500 AND low_n > 6 THEN 'VELOCITY_CARD_TESTING' END, CASE WHEN bin_n > 8 THEN 'VELOCITY_BIN_ATTACK' END,
  CASE WHEN prior_n >= 5 AND amount_minor > 4 * prior_mean THEN 'AMOUNT_ANOMALY' END], lambda x: x IS NOT NULL) AS c FROM x0),
y AS (SELECT *, len(list_filter(c, lambda x: x NOT IN {_SOFT})) > 0 AS hard, len(list_filter(c, lambda x: x IN {_SOFT})) AS soft FROM x),
r AS (SELECT *, CASE WHEN hard THEN 'DECLINE' WHEN soft = 0 THEN 'APPROVE' WHEN soft <= 2 THEN 'STEP_UP' ELSE 'REVIEW' END AS action,
  CASE WHEN hard THEN 'VERY_HIGH' WHEN soft = 0 THEN 'LOW' WHEN soft <= 2 THEN 'MEDIUM' ELSE 'HIGH' END AS band, CAST(CASE WHEN hard THEN 0.99 WHEN soft = 0 THEN 0.02 WHEN soft <= 2 THEN 0.5 ELSE 0.8 END AS DOUBLE) AS score FROM y)"""


RULES_ONLY = f"WITH {TXN}, {_mix()} SELECT txn_id, action, band, score, CAST(len(c) AS BIGINT) AS n_hits, array_to_string(c, ',') AS codes FROM r"
_WEIGHTS = dict(velocity_5m=0.35, velocity_1h=0.1, velocity_24h=0.04, amount_ratio=0.15, amount_zscore=0.25, device_spread=0.2, decline_rate=1.5, high_risk_mcc=1.1)
_LIMITS = dict(velocity_5m=("MODEL_HIGH_VELOCITY_5M", 3.0), velocity_1h=("MODEL_HIGH_VELOCITY_1H", 10.0), velocity_24h=("MODEL_HIGH_VELOCITY_24H", 25.0), amount_ratio=("MODEL_AMOUNT_RATIO", 3.0), amount_zscore=("MODEL_AMOUNT_ZSCORE", 2.0),
               device_spread=("MODEL_DEVICE_SPREAD", 3.0), decline_rate=("MODEL_DECLINE_RATE", 0.3), high_risk_mcc=("MODEL_HIGH_RISK_MCC", 0.5))
_REASONS = "list_transform(list_sort(list_filter([" + ", ".join(f"{{'weak': -(CAST(f_{n} AS DOUBLE) / {t}), 'ord': {k}, 'code': '{code}'}}" for k, (n, (code, t)) in enumerate(_LIMITS.items())) + "], lambda x: x.weak <= -1.0))[1:3], lambda x: x.code)"
_COSTS = dict(APPROVE=(100, 0), DECLINE=(0, 30), STEP_UP=(20, 5), REVIEW=(8, 15), HOLD=(5, 18))
_BEST = "list_sort([" + ", ".join(f"{{'cost': CAST(p * {a} + (1 - p) * {b} AS DOUBLE), 'ord': {k}, 'action': '{n}'}}" for k, (n, (a, b)) in enumerate(_COSTS.items())) + "])[1]"
_BAND = "CASE WHEN p < 0.3 THEN 'LOW' WHEN p < 0.6 THEN 'MEDIUM' WHEN p < 0.85 THEN 'HIGH' ELSE 'VERY_HIGH' END"
_Z = " + ".join(["-4.0", *(f"{w} * CAST(f_{n} AS DOUBLE)" for n, w in _WEIGHTS.items())])
EV = f"""WITH {_LAG}, fv AS (SELECT txn_id, {_FEATURES} FROM f), {_mix()},
s AS (SELECT r.*, {_REASONS} AS model_codes, CAST(1 / (1 + exp(-({_Z}))) AS DOUBLE) AS ms FROM r JOIN fv USING (txn_id)),
q AS (SELECT *, CASE WHEN hard THEN greatest(ms, 0.99) ELSE greatest(0.0, least(1.0, ms + 0.1 * soft)) END AS p FROM s)
SELECT txn_id, CASE WHEN hard THEN 'DECLINE' ELSE {_BEST}.action END AS action, CASE WHEN hard THEN 'VERY_HIGH' ELSE {_BAND} END AS band, round(CAST(p AS DOUBLE), 6) AS score, array_to_string(c || model_codes, ',') AS codes FROM q"""
DEGRADED = f"WITH {TXN}, {_mix()} SELECT txn_id, action, band, score, array_to_string(c || ['DEGRADED_RULES_ONLY'], ',') AS codes, 'none' AS model_version FROM r WHERE k % 9 IN (0, 1)"
MIX_CUBE = f"WITH {TXN}, {_mix()} SELECT action, merchant, count(*) AS n, round(avg(score), 6) AS mean_score FROM r GROUP BY CUBE (action, merchant)"
COSTS = f"WITH q AS (SELECT CAST(x AS DOUBLE) / 1000 AS p FROM range(1001) t(x)) SELECT round(p, 3) AS p, {_BEST}.action AS action, round({_BEST}.cost, 6) AS cost, {_BAND} AS band FROM q"
IDEMPOTENT = f"""WITH {TXN}, {_mix()} SELECT txn_id, txn_id % 7000 AS key, row_number() OVER w > 1 AS replayed, first_value(action) OVER w AS action, first_value(score) OVER w AS score FROM r WINDOW w AS (PARTITION BY txn_id % 7000 ORDER BY txn_id)"""
SCORED = "scored AS (SELECT doc_id, CAST(toxic AS INT) AS y, n_chars / (SELECT max(n_chars) FROM labels JOIN documents USING (doc_id)) AS score FROM labels JOIN documents USING (doc_id))"
CHAMPION = f"WITH {SCORED} SELECT doc_id, round(CASE WHEN doc_id % 10 = 3 THEN 1.0 ELSE score END, 9) AS model_score, round(1 - score, 9) AS shadow_score FROM scored"
AUDIT = f"WITH {TXN}, {_mix()} SELECT CAST(txn_id AS VARCHAR) AS transaction_id, action, band, score, array_to_string(c, ',') AS codes, us // 1000 AS decided_at_unix_ms, amount_minor AS amount_minor_units, CAST(len(c) AS BIGINT) AS n_fired FROM r"

_STRUCT = "st AS (SELECT acct, count(*) AS n_deposits FROM aml WHERE direction = 'in' AND amount_minor >= 25000000 AND amount_minor < 30000000 GROUP BY acct HAVING count(*) >= 3)"
_FUNNEL = "fu AS (SELECT acct, count(DISTINCT geography) FILTER (WHERE direction = 'in') AS n_geographies, count(DISTINCT counterparty) FILTER (WHERE direction = 'out') AS n_destinations FROM aml GROUP BY acct HAVING n_geographies >= 3 AND n_destinations BETWEEN 1 AND 2)"
_ROUND = """rt AS (SELECT acct, arg_min(amount_minor, seq) AS out_minor, min(seq) AS out_seq FROM aml o WHERE direction = 'out' AND EXISTS (
  SELECT 1 FROM aml i WHERE i.acct = o.acct AND i.direction = 'in' AND abs(i.us - o.us) // 1000000 <= 15552000 AND abs(i.amount_minor - o.amount_minor) <= 0.05::DOUBLE * o.amount_minor) GROUP BY acct)"""
STRUCTURING = f"WITH {AML}, {_STRUCT} SELECT * FROM st"
FUNNEL = f"WITH {AML}, {_FUNNEL} SELECT * FROM fu"
ROUND_TRIP = f"WITH {AML}, {_ROUND} SELECT * FROM rt"
_ALERTS = f"""{AML}, {_STRUCT}, {_FUNNEL}, {_ROUND}, al AS (
  SELECT acct, 0 AS ord, 'structuring' AS typology, n_deposits || ' deposits just below the CTR threshold' AS detail FROM st
  UNION ALL SELECT acct, 1, 'funnel', 'credits from ' || n_geographies || ' geographies, debits to ' || n_destinations || ' destinations' FROM fu
  UNION ALL SELECT acct, 2, 'round_tripping', 'outbound ' || out_minor || ' matched by a near-equal inbound' FROM rt)"""
AML_ALERTS = f"WITH {_ALERTS} SELECT acct, typology, detail FROM al"

_NAMES_SQL = """su AS (SELECT p_name AS name, min(p_type) AS dob, min(p_brand) AS nationality, 's-' || p_name AS subject_id FROM part GROUP BY p_name),
wl AS (SELECT p_partkey AS entry_id, p_name AS name, p_type AS dob, p_brand AS nationality, CASE p_partkey % 3 WHEN 0 THEN 'OFAC_SDN' WHEN 1 THEN 'PEP' ELSE 'ADVERSE_MEDIA' END AS list FROM part WHERE p_partkey % 7 = 0)"""
_MATCH = """ma AS (SELECT subject_id, entry_id, list, jaro_winkler_similarity(lower(trim(su.name)), lower(trim(wl.name))) AS s,
  list_filter([CASE WHEN su.dob = wl.dob THEN 'dob' END, CASE WHEN su.nationality = wl.nationality THEN 'nationality' END], lambda x: x IS NOT NULL) AS c FROM su, wl)"""
_GATE = "s >= 0.88 AND (len(c) > 0 OR (list = 'OFAC_SDN' AND s >= 0.95))"
SCREEN = f"WITH {_NAMES_SQL}, {_MATCH} SELECT subject_id, entry_id, list, round(s, 6) AS name_score, array_to_string(c, ',') AS corroboration FROM ma WHERE {_GATE}"
DELTA = f"WITH {_NAMES_SQL}, {_MATCH} SELECT subject_id, entry_id, round(s, 6) AS name_score FROM ma WHERE {_GATE} AND entry_id % 2 <> 0"

_CASES = """WITH RECURSIVE ev AS (
  SELECT user_id AS case_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'triage' WHEN 'click' THEN 'investigate' WHEN 'purchase' THEN 'sar_filed' WHEN 'signup' THEN 'closed' ELSE 'escalated' END AS to_state,
    'a' || (event_id % 3) AS actor, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
st AS (
  SELECT case_id, CAST(0 AS BIGINT) AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS from_state, NULL::VARCHAR AS to_state, NULL::VARCHAR AS error, 'alert' AS state, NULL::VARCHAR AS maker, NULL::VARCHAR AS checker FROM (SELECT DISTINCT case_id FROM ev)
  UNION ALL
  SELECT case_id, n, seq, from_state, to_state, error, CASE WHEN error IS NULL THEN to_state ELSE from_state END, CASE WHEN error IS NULL AND to_state = 'investigate' THEN actor ELSE maker END, CASE WHEN error IS NULL AND to_state = 'sar_filed' THEN actor ELSE checker END
  FROM (SELECT st.case_id, ev.n, ev.seq, st.state AS from_state, ev.to_state, ev.actor, st.maker, st.checker,
      CASE WHEN NOT ((st.state = 'alert' AND ev.to_state = 'triage') OR (st.state = 'triage' AND ev.to_state = 'investigate') OR (st.state = 'investigate' AND ev.to_state IN ('closed', 'escalated', 'sar_filed'))) THEN 'InvalidTransition'
        WHEN ev.to_state = 'sar_filed' AND st.maker IS NULL THEN 'MissingMaker' WHEN ev.to_state = 'sar_filed' AND st.maker = ev.actor THEN 'FourEyes' END AS error
    FROM st JOIN ev ON ev.case_id = st.case_id AND ev.n = st.n + 1))"""
CASES = f"{_CASES} SELECT case_id, seq, from_state, to_state, error, state, maker, checker FROM st WHERE n > 0"
DISPOSITION = f"""{_CASES}, l AS (SELECT case_id, arg_max(state, n) AS state FROM st WHERE n > 0 GROUP BY case_id)
SELECT case_id, state, CASE WHEN state = 'closed' THEN 'LEGIT' ELSE 'FRAUD' END AS value FROM l WHERE state IN ('closed', 'escalated', 'sar_filed')"""
_OPEN = f"""{_ALERTS}, inp AS (SELECT acct, max(seq) AS arrival, max(amount_minor) % 1000 / 1000 AS risk, 's-' || (acct % 64) AS subject_id FROM aml GROUP BY acct),
sc AS (SELECT 's-' || (p_partkey % 200) AS subject_id, list('sanctions:' || p_name ORDER BY p_partkey, p_name) AS s FROM part WHERE p_partkey % 7 = 0 GROUP BY 1),
am AS (SELECT acct, list('aml:' || typology ORDER BY ord) AS a FROM al GROUP BY acct),
oc AS (SELECT inp.*, coalesce(s, []) || coalesce(a, []) AS alerts FROM inp LEFT JOIN sc USING (subject_id) LEFT JOIN am USING (acct)),
od AS (SELECT *, row_number() OVER (ORDER BY arrival) AS case_no FROM oc WHERE len(alerts) > 0)"""
OPEN_CASES = f"WITH {_OPEN} SELECT 'case-' || case_no AS case_id, subject_id AS subject, risk, 'alert' AS state, array_to_string(alerts, ';') AS alerts FROM od"
QUEUE = f"""WITH {_OPEN} SELECT 'case-' || case_no AS case_id, subject_id AS subject, risk, CASE WHEN risk >= 0.85 THEN 'VERY HIGH' WHEN risk >= 0.6 THEN 'HIGH' WHEN risk >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM od
WHERE len(list_filter(alerts, lambda x: split_part(x, ':', 1) = 'aml')) > 0 AND (contains(lower(subject_id), 's-1') OR contains('case-' || case_no, 's-1')) ORDER BY risk DESC, case_no LIMIT 44"""
SAR = f"""WITH {_ALERTS}, ty AS (SELECT acct, list_sort(list(DISTINCT typology)) AS t FROM al GROUP BY acct), tot AS (SELECT acct, CAST(sum(amount_minor) AS BIGINT) AS total, max(occurred_at) AS d FROM aml GROUP BY acct)
SELECT 'case-' || acct AS case_id, 'acct-' || acct AS subject, array_to_string(t, ',') AS typologies, total AS total_amount_minor,
  'Subject acct-' || acct || ' exhibited suspicious activity (typologies: ' || array_to_string(t, ', ') || ') totalling ' || total || ' minor units, detected at ' || strftime(d, '%Y-%m-%dT%H:%M:%SZ') || '. Confidential — not for disclosure to the subject.' AS narrative,
  strftime(d + INTERVAL 30 DAY, '%Y-%m-%d') AS filing_deadline, strftime(d + INTERVAL 120 DAY, '%Y-%m-%d') AS continuing_activity_review, false AS disclose_to_subject FROM ty JOIN tot USING (acct)"""
CTR = f"WITH {AML} SELECT CAST(acct AS VARCHAR) AS subject, count(*) AS n, CAST(sum(amount_minor) AS BIGINT) AS cash_minor FROM aml WHERE amount_minor >= 40000000 GROUP BY acct"

EDGES = f"WITH {edges()} SELECT src, dst, count(*) AS n, CAST(sum(amount_minor) AS BIGINT) AS total_minor, max(time) AS last_seen FROM e GROUP BY src, dst"
_PAIRS = "p AS (SELECT DISTINCT src, dst FROM e), nd AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"
DEGREES = f"WITH {edges()}, {_PAIRS} SELECT node, (SELECT count(*) FROM p WHERE dst = node) AS in_degree, (SELECT count(*) FROM p WHERE src = node) AS out_degree FROM nd"
COUNTS = f"WITH {edges()}, {_PAIRS} SELECT (SELECT count(*) FROM nd) AS n_nodes, (SELECT count(*) FROM p) AS n_edges"
COMPONENTS = f"""WITH RECURSIVE {edges()}, {_PAIRS}, un AS (SELECT src, dst FROM p UNION SELECT dst, src FROM p),
re AS (SELECT node, node AS other FROM nd UNION SELECT re.node, un.dst FROM re JOIN un ON un.src = re.other)
SELECT node, min(other) AS component FROM re GROUP BY node"""
HUBS = f"""WITH {edges()}, {_PAIRS}, i AS (SELECT dst AS node, count(*) AS n_sources, list(src ORDER BY src) AS s FROM p GROUP BY dst HAVING count(*) >= 3)
SELECT node, n_sources, node || ',' || array_to_string(s, ',') AS members FROM i WHERE node IN (SELECT src FROM p)"""
SCATTER = f"WITH {edges()}, {_PAIRS} SELECT a.src, b.dst AS sink, count(*) AS n_mids FROM p a JOIN p b ON a.dst = b.src WHERE a.src <> b.dst GROUP BY ALL HAVING count(*) >= 3"
_T = "t AS (SELECT src, dst, max(time) AS t FROM e WHERE src <> dst GROUP BY ALL)"
_falls = lambda ts: " + ".join(f"CAST({a} > {b} AS INT)" for a, b in zip(ts, ts[1:] + ts[:1]))
RINGS = f"""WITH {edges()}, {_T}
SELECT a.src || '>' || a.dst AS ring, CAST(2 AS BIGINT) AS length FROM t a JOIN t b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst AND {_falls(['a.t', 'b.t'])} <= 1
UNION ALL SELECT a.src || '>' || a.dst || '>' || b.dst, 3 FROM t a JOIN t b ON a.dst = b.src JOIN t c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst AND {_falls(['a.t', 'b.t', 'c.t'])} <= 1
UNION ALL SELECT a.src || '>' || a.dst || '>' || b.dst || '>' || c.dst, 4 FROM t a JOIN t b ON a.dst = b.src JOIN t c ON b.dst = c.src JOIN t d ON c.dst = d.src AND d.dst = a.src
  WHERE a.src < a.dst AND a.src < b.dst AND a.src < c.dst AND a.dst <> b.dst AND b.dst <> c.dst AND a.dst <> c.dst AND {_falls(['a.t', 'b.t', 'c.t', 'd.t'])} <= 1"""
DISTANCE = f"""WITH RECURSIVE {edges()}, {_PAIRS}, un AS (SELECT src, dst FROM p UNION SELECT dst, src FROM p),
b AS (SELECT node, CAST(0 AS BIGINT) AS d FROM nd WHERE node IN ('n1', 'n2', 'n3') UNION SELECT un.dst, b.d + 1 FROM b JOIN un ON un.src = b.node WHERE b.d < 40)
SELECT nd.node, coalesce(min(d), -1) AS dist FROM nd LEFT JOIN b USING (node) GROUP BY nd.node"""
ENTITIES = """WITH RECURSIVE r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'd' || CAST(trunc(c_custkey / 49) AS INT) END AS dev, CASE WHEN c_custkey % 11 = 0 THEN 'p1' || CAST(trunc(c_custkey / 121) AS INT) || '00' END AS ph FROM customer),
k AS (SELECT id, dev AS v FROM r WHERE dev IS NOT NULL UNION SELECT id, ph FROM r WHERE ph IS NOT NULL),
un AS (SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b ON a.v = b.v), re AS (SELECT id, id AS other FROM r UNION SELECT re.id, un.b FROM re JOIN un ON un.a = re.other)
SELECT id, min(other) AS cluster FROM re GROUP BY id"""


def _pagerank(bad: str | None, directed: bool, rounds: int = 5) -> str:
    last = "l0 AS (SELECT src, dst, CAST(arg_max(amount_minor, seq) AS DOUBLE) AS w FROM e GROUP BY ALL)"
    full = "l AS (SELECT * FROM l0)" if directed else "l AS (SELECT src, dst, max(w) AS w FROM (SELECT * FROM l0 UNION ALL SELECT dst, src, w FROM l0) GROUP BY ALL)"
    hit = f"CASE WHEN node IN ({bad}) THEN 1.0 ELSE 0.0 END" if bad else "1.0"
    out = f"""WITH {edges()}, {_PAIRS}, {last}, {full}, sh AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM l),
hn AS (SELECT node, CAST({hit} AS DOUBLE) AS h, node NOT IN (SELECT src FROM sh) AS dang FROM nd), v AS (SELECT node, h / (SELECT sum(h) FROM hn) AS tele, dang FROM hn),
k0 AS (SELECT node, tele AS rank FROM v)"""
    for n in range(1, rounds + 1):
        out += f""", g{n} AS (SELECT dst AS node, sum(rank * p) AS got FROM k{n - 1} JOIN sh ON src = node GROUP BY dst), d{n} AS (SELECT coalesce(sum(rank), 0) AS lost FROM k{n - 1} JOIN v USING (node) WHERE dang),
k{n} AS (SELECT v.node, 0.85 * (coalesce(got, 0) + lost * tele) + 0.15 * tele AS rank FROM v LEFT JOIN g{n} USING (node), d{n})"""
    return out + f" SELECT node, round(CAST(rank AS DOUBLE), 8) AS rank FROM k{rounds}"


PAGERANK = _pagerank(None, True)
PPR = _pagerank("'n1', 'n2', 'n3'", False)
_ACT = """i AS (SELECT dst AS account, count(DISTINCT src) AS fan_in, sum(amount_minor) AS inflow, min(time) AS first_in FROM e GROUP BY dst), o AS (SELECT src AS account, count(DISTINCT dst) AS fan_out, sum(amount_minor) AS outflow, max(time) AS last_out, min(time) AS first_out FROM e GROUP BY src),
ac AS (SELECT account, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, coalesce(inflow, 0) AS inflow, coalesce(outflow, 0) AS outflow, coalesce(floor((last_out - first_in) / 1000000), 0) AS dwell,
  floor((least(first_in, first_out) - (SELECT min(time) FROM e)) / 86400000000) AS dormant FROM i FULL JOIN o USING (account)),
mu AS (SELECT *, fan_in >= 5 AND fan_out BETWEEN 1 AND 2 AS s1, inflow > 0 AND abs(CAST(outflow AS DOUBLE) / CAST(inflow AS DOUBLE) - 1) <= 0.1 AS s2, outflow > 0 AND dwell <= 3600 AS s3, dormant >= 30 AND inflow > 0 AS s4 FROM ac),
ms AS (SELECT *, least(1.0, CASE WHEN s1 THEN 0.4 ELSE 0 END + CASE WHEN s2 THEN 0.3 ELSE 0 END + CASE WHEN s3 THEN 0.2 ELSE 0 END + CASE WHEN s4 THEN 0.3 ELSE 0 END) AS score FROM mu)"""
MULE = f"""WITH {edges()}, {_ACT} SELECT account, round(CAST(score AS DOUBLE), 6) AS mule_score, array_to_string(list_filter([CASE WHEN s1 THEN 'fan_in_fan_out' END, CASE WHEN s2 THEN 'pass_through' END, CASE WHEN s3 THEN 'short_dwell' END, CASE WHEN s4 THEN 'dormant_then_active' END], lambda x: x IS NOT NULL), ',') AS signals, score >= 0.5 AS alert FROM ms"""
FREEZE = f"WITH {edges()}, {_ACT} SELECT account, score >= 0.5 AS freeze, CASE WHEN score >= 0.5 THEN 'HARD_DECLINE' END AS disposition, score >= 0.5 AS file_sar FROM ms"
APP_FRAUD = f"""WITH {TXN}, a AS (SELECT txn_id AS seq, user_id AS payer, k AS payee, amount_minor, us, row_number() OVER (PARTITION BY user_id, k ORDER BY us, txn_id) = 1 AS new_payee,
  coalesce(max(amount_minor) OVER (PARTITION BY user_id ORDER BY us, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior_max FROM txn),
b AS (SELECT *, CAST(coalesce(sum(CAST(new_payee AS INT)) OVER (PARTITION BY payee ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior_payers FROM a)
SELECT seq, new_payee, prior_max, prior_payers, new_payee AND amount_minor > prior_max AND prior_payers < 5 AS app_fraud FROM b"""
COERCION = f"WITH {TXN} SELECT txn_id, 'HOLD' AS action, true AS show_warning FROM txn WHERE k % 3 = 0 AND (k % 4 = 0 OR k / 2 >= 20)"
_LEDGER = """li AS (SELECT DISTINCT l_orderkey AS txid, 'p' || l_partkey AS a FROM lineitem), lo AS (SELECT l_orderkey AS txid, 's' || l_suppkey AS a, CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem),
cj AS (SELECT txid, (SELECT count(*) FROM li WHERE li.txid = x.txid) >= 3 AND max(n) >= 3 AS coinjoin FROM (SELECT txid, v, count(*) AS n FROM lo GROUP BY ALL) x GROUP BY txid)"""
LEDGER_VALUE = f"WITH {_LEDGER} SELECT txid, CAST(sum(v) AS BIGINT) AS output_minor, any_value(coinjoin) AS coinjoin FROM lo JOIN cj USING (txid) GROUP BY txid"
ADDRESS_CLUSTERS = f"""WITH RECURSIVE {_LEDGER}, un AS (SELECT DISTINCT x.a AS a, y.a AS b FROM li x JOIN li y USING (txid) JOIN cj USING (txid) WHERE NOT coinjoin), ad AS (SELECT a FROM li UNION SELECT a FROM lo),
re AS (SELECT a, a AS other FROM ad UNION SELECT re.a, un.b FROM re JOIN un ON un.a = re.other) SELECT a AS address, min(other) AS cluster FROM re GROUP BY a"""
def _peel(ratio: float, hops: int) -> str:
    """Walks as a recursion: a hop back to a node of the chain counts, but none follows it."""
    return f"""WITH RECURSIVE {edges()}, bg AS (SELECT src, count(*) AS n, sum(amount_minor) AS total, max({{'v': amount_minor, 's': seq, 'd': dst}}) AS m FROM e GROUP BY src), dm AS (SELECT src, m.d AS nxt FROM bg WHERE n >= 2 AND m.v >= {ratio} * total),
wk AS (SELECT DISTINCT dst AS start, dst AS at, [dst] AS seen, 0 AS hops, false AS closed FROM e WHERE src IN ('n1', 'n2', 'n3')
UNION ALL SELECT start, nxt, list_append(seen, nxt), hops + 1, list_contains(seen, nxt) FROM wk JOIN dm ON dm.src = wk.at WHERE NOT closed AND hops < {hops})
SELECT start, CAST({hops} AS BIGINT) AS length FROM wk WHERE hops = {hops}"""


PEEL, PEEL_3, PEEL_DEFAULT = _peel(0.02, 1), _peel(0.015, 3), _peel(0.8, 3)
SANCTIONS = """SELECT o_orderkey, o_custkey AS address, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INT) AS day, 'CRYPTO_SANCTIONS' AS reason_code FROM orders
WHERE o_custkey % 5 = 0 AND o_custkey IN (SELECT c_custkey FROM customer) AND date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) >= o_custkey % 1000 AND (o_custkey % 10 <> 0 OR date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) < o_custkey % 1000 + 900)"""
_ADDR = "'0xab' || lpad(CAST(user_id AS VARCHAR), 4, '0') || {mid} || lpad(CAST(user_id % 97 AS VARCHAR), 4, '0')"
POISON = f"""WITH {TXN}, r AS (SELECT {_ADDR.format(mid="'real'")} AS a, us FROM txn WHERE k % 2 = 0), f AS (SELECT txn_id, {_ADDR.format(mid="CASE WHEN k % 3 = 0 THEN 'real' ELSE 'fake' END")} AS address, us FROM txn WHERE k % 2 = 1)
SELECT txn_id, address, 'CRYPTO_ADDR_POISON' AS reason_code FROM f WHERE EXISTS (SELECT 1 FROM r WHERE left(r.a, 4) = left(f.address, 4) AND right(r.a, 4) = right(f.address, 4) AND r.a <> f.address AND f.us - r.us BETWEEN 0 AND 21600000000)"""
TRAVEL_RULE = f"WITH {TXN} SELECT txn_id, amount_minor * 10 AS amount_minor, 'CRYPTO_TRAVEL_RULE' AS reason_code FROM txn WHERE k % 2 = 0 AND k % 3 = 0 AND k % 5 <> 0 AND amount_minor * 10 >= 100000"
LABELS = f"""WITH {TXN}, l AS (SELECT txn_id % 4000 AS id, txn_id AS seq, CASE WHEN declined THEN 'FRAUD' ELSE 'LEGIT' END AS value, CASE WHEN k % 3 = 0 THEN 'CHARGEBACK' ELSE 'INVESTIGATOR' END AS source, us + CASE WHEN k % 3 = 0 THEN 10 ELSE 1 END * 86400000000 AS available_us FROM txn)
SELECT id AS txn_id, value, source, available_us FROM l WHERE available_us <= {AS_OF[1]} QUALIFY row_number() OVER (PARTITION BY id ORDER BY source <> 'CHARGEBACK', seq) = 1"""
RETRAIN = f"""WITH {SCORED} SELECT doc_id AS subject, y AS label, CAST(1.0 AS DOUBLE) AS weight, 'investigator' AS origin FROM scored WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, CAST(score >= 0.5 AS INT), round(2 * abs(score - 0.5), 9), 'reject_inference' FROM scored WHERE doc_id % 2 = 1"""
PSI = """WITH b AS (SELECT value AS v, ts >= TIMESTAMP '2024-01-16' AS cur FROM events), s AS (SELECT min(v) AS lo, max(v) AS hi, count(*) FILTER (WHERE NOT cur) AS n0, count(*) FILTER (WHERE cur) AS n1 FROM b),
c AS (SELECT least(floor((v - lo) / ((hi - lo) / 10)), 9) AS bin, count(*) FILTER (WHERE NOT cur) AS c0, count(*) FILTER (WHERE cur) AS c1 FROM b, s GROUP BY 1),
g AS (SELECT greatest(coalesce(c0, 0) / n0, 1e-6) AS p0, greatest(coalesce(c1, 0) / n1, 1e-6) AS p1 FROM range(10) r(x) LEFT JOIN c ON c.bin = x, s)
SELECT round(sum((p1 - p0) * ln(p1 / p0)), 9) AS psi, sum((p1 - p0) * ln(p1 / p0)) > 0.25 AS drift FROM g"""
_CURVE = f"""WITH {SCORED}, g AS (SELECT score, sum(y) AS pos, count(*) AS n FROM scored GROUP BY score),
c AS (SELECT score, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS alerts, (SELECT sum(y) FROM scored) AS p, (SELECT count(*) - sum(y) FROM scored) AS neg FROM g WINDOW w AS (ORDER BY score DESC))"""
PR_AUC = f"{_CURVE} SELECT round(sum(CAST(pos AS DOUBLE) / p * tp / alerts), 9) AS pr_auc FROM c"
RECALL = f"""{_CURVE}, b AS (SELECT * FROM c WHERE CAST(alerts - tp AS DOUBLE) / neg <= 0.05 ORDER BY CAST(tp AS DOUBLE) / p DESC, score DESC LIMIT 1)
SELECT round(CAST(tp AS DOUBLE) / p, 9) AS recall, round(score, 9) AS threshold, round(CAST(alerts AS DOUBLE) / greatest(tp, 1), 9) AS alert_to_fraud FROM b"""
PRECISION = f"WITH {SCORED} SELECT round(avg(y), 9) AS precision FROM (SELECT y FROM scored ORDER BY score DESC, doc_id LIMIT 50)"
RANKS = "SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99, quantile_disc(value, 0.999) AS p99_9 FROM events"
MONEY = f"""WITH {TXN}, c AS (SELECT *, CASE k % 4 WHEN 0 THEN 'JPY' WHEN 1 THEN 'EUR' ELSE 'USD' END AS ccy, CASE WHEN k % 2 = 0 THEN -amount_minor ELSE amount_minor END AS m, amount_minor % 120 AS mi, k - 50 AS ma FROM txn)
SELECT txn_id, CASE WHEN m < 0 THEN '-' ELSE '' END || CASE WHEN ccy = 'JPY' THEN CAST(abs(m) AS VARCHAR) ELSE (abs(m) // 100) || '.' || lpad(CAST(abs(m) % 100 AS VARCHAR), 2, '0') END || ' ' || ccy AS text,
  CAST(CASE WHEN ccy = 'JPY' THEN CASE WHEN mi < 1 THEN ma END WHEN mi < 100 THEN ma * 100 + CASE WHEN ma < 0 THEN -mi ELSE mi END END AS BIGINT) AS built FROM c"""
TIERS = f"""WITH {SCORED} SELECT doc_id, CASE WHEN score >= 0.85 THEN 'VERY HIGH' WHEN score >= 0.6 THEN 'HIGH' WHEN score >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS tier,
  CASE WHEN score < 0.3 THEN 'LOW' WHEN score < 0.6 THEN 'MEDIUM' WHEN score < 0.85 THEN 'HIGH' ELSE 'VERY_HIGH' END AS band, score * 2 <= 1 AS valid FROM scored"""

REQUESTS = """WITH r AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events), p AS (SELECT *, CASE WHEN k % 6 = 0 THEN NULL WHEN k % 6 = 1 THEN '123' ELSE '41111100' || lpad(CAST(user_id AS VARCHAR), 8, '0') END AS pan FROM r)
SELECT CAST(event_id AS VARCHAR) AS txn_id, CASE WHEN k % 50 = 0 THEN 0 ELSE epoch_us(ts) // 1000 * 1000 END AS us, CASE k % 5 WHEN 0 THEN 'EUR' WHEN 2 THEN 'JPY' ELSE 'USD' END AS currency, CASE WHEN k % 3 = 0 THEN 'P2P' ELSE 'CARD' END AS vertical,
  CASE WHEN k % 4 = 0 THEN 'CARD_PRESENT' ELSE 'CARD_NOT_PRESENT' END AS channel, CASE WHEN length(pan) >= 6 THEN left(pan, 6) END AS bin, CASE WHEN pan IS NOT NULL THEN coalesce(CASE WHEN length(pan) >= 6 THEN left(pan, 6) END, '') || '****' || right(pan, 4) END AS card_token,
  CAST(NULL AS VARCHAR) AS merchant, 'd' || k AS device, CASE WHEN k % 7 = 0 THEN '10.0.0.' || k END AS ip, CASE WHEN k % 2 = 1 THEN 5411 END AS mcc, CASE WHEN k % 2 = 0 THEN CAST(1.5 AS DOUBLE) END AS lat FROM p"""
TELEMETRY = """WITH c AS (SELECT ['baseline', 'fraud-surge', 'card-testing', 'degrade'][id % 4 + 1] AS scenario, CAST(id * 160 AS DOUBLE) AS target_tps, id % 5 = 0 AS fault FROM range(160) t(id)),
d AS (SELECT *, CAST(CASE scenario WHEN 'baseline' THEN 23000 WHEN 'fraud-surge' THEN 20500 WHEN 'card-testing' THEN 21500 ELSE 14000 END * CASE WHEN fault THEN 0.6 ELSE 1.0 END AS DOUBLE) AS cap, CAST(target_tps AS BIGINT) AS offered,
  CASE scenario WHEN 'baseline' THEN 0.932 WHEN 'fraud-surge' THEN 0.69 WHEN 'card-testing' THEN 0.7 ELSE 0.9 END AS approve_share, (-(16 / 2.4::DOUBLE) + sqrt(pow(16 / 2.4::DOUBLE, 2) + 4 * 16 / 2.4::DOUBLE)) / 2 AS r19, (-(17 / 2.4::DOUBLE) + sqrt(pow(17 / 2.4::DOUBLE, 2) + 4 * 17 / 2.4::DOUBLE)) / 2 AS r20 FROM c),
e AS (SELECT *, CASE WHEN offered > cap * r19 THEN CAST(round(cap * r19) AS BIGINT) ELSE offered END AS admitted FROM d)
SELECT scenario, target_tps, fault, offered, admitted, offered - admitted AS shed, round(admitted / cap, 6) AS rho, least(30.0::DOUBLE, round(3 + 2.4::DOUBLE * pow(least(0.97, admitted / cap), 2) / (1 - least(0.97, admitted / cap)), 1)) AS p99, offered > cap * r19 AS degrade,
  CAST(round(cap * r20) AS BIGINT) AS wall_tps, CAST(approve_share AS DOUBLE) AS approve_share FROM e"""
SIM_TOTALS = """SELECT * FROM (VALUES ('legitimate', 100::BIGINT, 100::BIGINT, 0::BIGINT, 0::BIGINT), ('card_testing', 100, 5, 95, 95), ('high_amount', 100, 5 + 0, 0, 0), ('blocklisted_bin', 100, 0, 100, 100)) t(scenario, processed, approved, declined, alerts) WHERE scenario <> 'high_amount'
UNION ALL (WITH RECURSIVE h AS (SELECT 0::BIGINT AS i, 0::BIGINT AS hits, 0.0::DOUBLE AS mean UNION ALL
  SELECT i + 1, hits + CASE WHEN i >= 5 AND (CASE WHEN i < 5 THEN 5000 ELSE 900000 END) > 10 * mean THEN 1 ELSE 0 END, mean + ((CASE WHEN i < 5 THEN 5000 ELSE 900000 END) - mean) / (i + 1) FROM h WHERE i < 100)
  SELECT 'high_amount', 100, 100 - hits, 0, hits FROM h WHERE i = 100)"""
HOPS = """WITH w AS (SELECT *, unnest([0, 1]) AS j FROM events), s AS (SELECT (epoch_us(ts) // 43200000000 - j) * 43200000000 AS start_us, event_type, value FROM w)
SELECT start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY ALL"""
SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT epoch_us(min(ts)) AS start_us, user_id, count(*) AS n FROM s GROUP BY user_id, k"""
MOMENTS = f"""WITH {TXN}, g AS (SELECT card_token, count(*) AS n, CAST(sum(amount_minor) AS DOUBLE) AS t, CAST(sum(CAST(amount_minor AS HUGEINT) * amount_minor) AS DOUBLE) AS q FROM txn GROUP BY card_token)
SELECT card_token, round(t / n, 6) AS mean, round(CASE WHEN n >= 2 THEN sqrt(greatest(0, q / n - (t / n) * (t / n))) ELSE 0 END, 4) AS std FROM g"""

ASOF_SHIPMENT = """WITH s AS (
  SELECT o_custkey, epoch_us(l_shipdate) AS us, max(ROW(l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT))) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT o_orderkey, o.o_custkey, x[1] AS asof_l_orderkey, x[2] AS asof_l_linenumber, s.us AS asof_us, x[3] AS asof_minor FROM orders o ASOF LEFT JOIN s ON o.o_custkey = s.o_custkey AND epoch_us(o.o_orderdate) >= s.us"""
ASOF_DECLINE = f"""WITH {TXN}, d AS (SELECT merchant, us, max(txn_id) AS txn_id, arg_max(amount_minor, txn_id) AS amount_minor FROM txn WHERE declined GROUP BY 1, 2)
SELECT t.txn_id, CASE WHEN t.us - d.us <= 21600000000 THEN d.txn_id END AS asof_txn_id, CASE WHEN t.us - d.us <= 21600000000 THEN d.amount_minor END AS asof_amount_minor
FROM txn t ASOF LEFT JOIN d ON t.merchant = d.merchant AND t.us > d.us"""

STRONG = f"""WITH RECURSIVE {edges()}, p AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst), nd AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
re AS (SELECT node AS a, node AS b FROM nd UNION SELECT re.a, p.dst FROM re JOIN p ON p.src = re.b)
SELECT x.a AS node, max(x.b) AS component FROM re x JOIN re y ON x.a = y.b AND x.b = y.a GROUP BY x.a"""
RINGS_DAY = f"""WITH RECURSIVE {edges()}, p AS (SELECT src, dst, max(time) AS t FROM e WHERE src <> dst GROUP BY 1, 2),
w AS (
  SELECT src AS head, dst AS tail, [src, dst] AS nodes, t AS t0, t AS last, ROW(t, src, dst) AS f, true AS least, false AS closed FROM p
  UNION ALL
  SELECT head, dst, CASE WHEN dst = head THEN nodes ELSE list_append(nodes, dst) END, t0, t, f, least AND ROW(t, p.src, p.dst) > f, dst = head FROM w JOIN p ON p.src = w.tail
  WHERE NOT closed AND t >= last AND t - t0 <= 86400000000 AND (dst = head OR NOT list_contains(nodes, dst)))
SELECT array_to_string(list_concat(nodes[k:], nodes[:k - 1]), '>') AS ring, CAST(len(nodes) AS BIGINT) AS length FROM (SELECT nodes, list_position(nodes, list_min(nodes)) AS k FROM w WHERE closed AND (last > t0 OR least))"""

HUB_MEMBERS = f"""WITH {edges()}, {_PAIRS}, h AS (SELECT dst AS node FROM p GROUP BY dst HAVING count(*) >= 3)
SELECT node, src AS member FROM h JOIN p ON dst = node WHERE node IN (SELECT src FROM p)"""
SAME_CLUSTER = f"""WITH RECURSIVE {_LEDGER}, un AS (SELECT DISTINCT x.a AS a, y.a AS b FROM li x JOIN li y USING (txid) JOIN cj USING (txid) WHERE NOT coinjoin), ad AS (SELECT a FROM li UNION SELECT a FROM lo),
re AS (SELECT a, a AS other FROM ad UNION SELECT re.a, un.b FROM re JOIN un ON un.a = re.other), cl AS (SELECT a, min(other) AS c FROM re GROUP BY a),
pr AS (SELECT 'p' || p_partkey AS a, CASE WHEN p_partkey % 5 = 0 THEN 'unseen' ELSE 'p' || (p_partkey + 1) END AS b FROM part)
SELECT pr.a, pr.b, coalesce(x.c = y.c, false) AS same FROM pr LEFT JOIN cl x ON x.a = pr.a LEFT JOIN cl y ON y.a = pr.b"""
COUNTERPARTY = f"""WITH {TXN} SELECT txn_id, 'acct-' || (k % 30) AS counterparty,
  array_to_string(list_filter(['BLOCKLIST_COUNTERPARTY', CASE WHEN NOT avs_match THEN 'AVS_MISMATCH' END, CASE WHEN NOT cvv_match THEN 'CVV_MISMATCH' END], lambda x: x IS NOT NULL), ',') AS codes FROM txn WHERE k % 4 > 0 AND k % 30 IN (7, 13)"""
WINDOW_MAP = f"WITH {TXN}, w AS (SELECT txn_id, {windows('card_token')} FROM txn) SELECT txn_id, '{','.join(HORIZONS)}' AS labels, " + ", ".join(
    f"CAST({p}_{h} AS BIGINT) AS {f}_{h}" for h in ("5m", "7d") for p, f in (("cnt", "count"), ("sum", "sum_minor"), ("dev", "distinct_devices"), ("dec", "decline_count"))) + " FROM w"
MONEY_SUMS = f"""WITH {TXN}, m AS (SELECT txn_id, amount_minor AS a, CASE WHEN k = 3 THEN 9223372036854775807 ELSE amount_minor END AS big,
  CASE k % 3 WHEN 0 THEN 'JPY' WHEN 1 THEN 'EUR' ELSE 'USD' END AS c, CASE k % 4 WHEN 0 THEN 'JPY' WHEN 1 THEN 'EUR' ELSE 'USD' END AS d FROM txn)
SELECT txn_id, CASE WHEN c = d THEN TRY_CAST(CAST(big AS HUGEINT) + a AS BIGINT) END AS added, CASE WHEN c = d THEN TRY_CAST(CAST(a AS HUGEINT) - big AS BIGINT) END AS less FROM m"""
ZIPPED = f"WITH {SCORED} SELECT 's' || doc_id AS subject, round(score, 9) AS p FROM scored"


def _share(salt: int) -> str:
    """FNV-1a over the id's bytes in 64 bits, begun with a salted basis; its last four decimal digits as a share."""
    return f"""(list_reduce(list_prepend(CAST({0xCBF29CE484222325 ^ salt} AS HUGEINT), list_transform(string_split('txn-' || txn_id, ''), lambda x: CAST(ascii(x) AS HUGEINT))),
    lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) % 10000) / 10000"""


DELAYED = f"""WITH {TXN}, {_mix()}, s AS (SELECT txn_id, us, declined AS fraud, action, {_share(0x11111111)} < 0.01 AS holdout, {_share(0x22222222)} < 0.05 AS i, {_share(0x33333333)} < 0.1 AS f FROM r)
SELECT 'txn-' || txn_id AS txn_id, CASE WHEN fraud THEN 'FRAUD' ELSE 'LEGIT' END AS value, 'CHARGEBACK' AS source, us + 3888000000000 AS available_us, holdout FROM s WHERE holdout OR action = 'APPROVE'
UNION ALL SELECT 'txn-' || txn_id, CASE WHEN fraud <> f THEN 'FRAUD' ELSE 'LEGIT' END, 'INVESTIGATOR', us + 21600000000, holdout FROM s WHERE i"""
