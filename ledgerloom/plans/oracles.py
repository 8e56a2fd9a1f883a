"""The registered queries again as plain SQL, written independently of the Spark plans."""

from __future__ import annotations

# ── shared pieces ─────────────────────────────────────────────────────────────

BUCKET = """CASE WHEN category = 'Income' THEN 'Income' WHEN category = 'Transfers' THEN 'Transfers'
 WHEN category IN ('Rent','Utilities','Tools','Health/Fitness','Subscriptions','Fees') THEN 'Fixed'
 WHEN category = 'Groceries' THEN 'Groceries' WHEN category = 'FoodDelivery' THEN 'FoodDelivery'
 ELSE 'Other' END"""
BUCKET_ROWS = "(VALUES ('Income'),('Transfers'),('Fixed'),('Groceries'),('FoodDelivery'),('Other')) b(bucket)"
GROSS = "amount_cents < 0 AND category NOT IN ('Income','Transfers')"
WINDOW = "booking_date BETWEEN DATE '2001-04-01' AND DATE '2001-06-30'"
LONG = "booking_date BETWEEN DATE '1999-01-15' AND DATE '2001-06-30'"
EVENTS = "booking_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-25'"


ACCOUNTS = "SELECT CAST(c_custkey AS VARCHAR) AS account_id FROM customer"


def net(threshold: int) -> str:
    return (f"category NOT IN ('Income','Transfers') AND NOT "
            f"(amount_cents >= {threshold} AND category = 'Uncategorized')")


RULES = """CASE WHEN k LIKE '%PLATE' THEN 'Groceries' WHEN k LIKE '%ROD' THEN 'Rent'
 WHEN k LIKE '%GEAR' THEN 'Transport' WHEN k LIKE '%GIZMO' THEN 'FoodDelivery'
 WHEN k LIKE '%WIDGET' THEN 'Tools' WHEN k LIKE '%RING' THEN 'Coffee/Snacks'
 WHEN k LIKE '%BOLT' THEN 'Utilities' WHEN k LIKE '%E' THEN 'Shopping' END"""

HOUSEHOLD = f"""named AS (
 SELECT p_partkey, p_name, CASE WHEN p_brand <> 'Brand#13' THEN 'POS ' || upper(p_name) || ' ' || p_partkey END AS merchant_raw,
  CASE WHEN p_brand <> 'Brand#13' THEN upper(p_name) END AS k FROM part),
sales AS (
 SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS id,
  CAST(o_custkey AS VARCHAR) AS account_id, CAST(l_shipdate AS DATE) AS booking_date,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END * CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_cents,
  merchant_raw, k AS merchant_key, COALESCE({RULES}, 'Uncategorized') AS category,
  'sales' AS batch_id, l_orderkey * 8 + l_linenumber AS batch_ord
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN named ON l_partkey = p_partkey),
income AS (
 SELECT 'order-' || o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS account_id, CAST(o_orderdate AS DATE) AS booking_date,
  CASE WHEN o_orderpriority = '2-HIGH' THEN -(CAST(round(o_totalprice * 100) AS BIGINT) // 1000)
   WHEN o_orderpriority[1:1] IN ('4', '5') AND o_orderstatus = 'F' THEN -CAST(round(o_totalprice * 100) AS BIGINT)
   ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS amount_cents,
  CASE o_orderpriority[1:1] WHEN '1' THEN 'SALARY' WHEN '2' THEN 'BANK FEE' WHEN '3' THEN 'BONUS' ELSE 'HOUSE TRANSFER' END AS merchant_raw,
  CASE o_orderpriority[1:1] WHEN '1' THEN 'SALARY' WHEN '2' THEN 'BANK FEE' WHEN '3' THEN 'BONUS' ELSE 'HOUSE TRANSFER' END AS merchant_key,
  CASE o_orderpriority[1:1] WHEN '1' THEN 'Income' WHEN '2' THEN 'Fees' WHEN '3' THEN 'Income' ELSE 'Transfers' END AS category,
  'income' AS batch_id, o_orderkey AS batch_ord
 FROM orders),
hh AS (SELECT * FROM sales UNION ALL BY NAME SELECT * FROM income)"""

EVENT = """ev AS (
 SELECT sha256(CAST(event_id AS VARCHAR)) AS id, CAST(user_id AS VARCHAR) AS account_id, CAST(ts AS DATE) AS booking_date, ts,
  CASE WHEN event_type = 'signup' OR value < 2 THEN 1 ELSE -1 END * CAST(round(value * 100) AS BIGINT) AS amount_cents,
  'SUMUP *' || event_type || ' house' AS merchant_raw, upper(event_type) || ' HOUSE' AS merchant_key,
  CASE event_type WHEN 'purchase' THEN 'Groceries' WHEN 'view' THEN 'FoodDelivery' WHEN 'click' THEN 'Coffee/Snacks'
   ELSE 'Uncategorized' END AS category, event_id AS batch_ord
 FROM events)"""

STATEMENT = """st AS (
 SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS q, l_returnflag AS rf,
  CASE WHEN l_quantity = 13 THEN '' ELSE 'ACC-' || o_orderpriority END AS account,
  CASE WHEN l_quantity = 7 THEN 'soon' WHEN l_linenumber = 1 THEN strftime(l_shipdate, '%d/%m/%Y')
   WHEN l_linenumber = 2 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE strftime(l_shipdate, '%d/%m/%y') END AS date,
  CASE WHEN l_quantity = 3 THEN replace(format('{:,.2f}', l_extendedprice), ',', '.') WHEN l_quantity = 5 THEN '0.00'
   WHEN l_quantity = 9 THEN '' WHEN l_quantity = 15 THEN ' €' || format('{:,.2f}', l_extendedprice)
   ELSE format('{:,.2f}', l_extendedprice) END AS amount,
  CASE WHEN l_quantity = 11 THEN 'Pending card' ELSE 'Debit' END AS type,
  CASE WHEN l_quantity = 17 THEN 'USD' ELSE 'EUR' END AS currency,
  p_name || ' no ' || l_partkey AS text, 'file-' || l_suppkey AS file_path,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS px, CAST(l_shipdate AS DATE) AS day,
  l_orderkey * 8 + l_linenumber AS batch_ord
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
st2 AS (
 SELECT *, CASE WHEN rf = 'R' THEN '' ELSE amount END AS debit,
  CASE WHEN rf = 'R' THEN amount WHEN q = 21 THEN '1.00' ELSE '' END AS credit,
  CASE WHEN q = 3 AND px >= 100000 THEN NULL WHEN q = 5 THEN 0 WHEN q = 9 THEN 0 ELSE px END AS cents FROM st),
st3 AS (
 SELECT *, CASE WHEN rf = 'R' THEN cents ELSE CASE WHEN q = 21 THEN 100 ELSE 0 END - cents END AS amount_cents FROM st2),
verdict AS (
 SELECT *, CASE WHEN q = 11 THEN 'skip:pending' WHEN debit = '' AND credit = '' THEN 'skip:no_amount'
   WHEN amount_cents IS NULL THEN 'reject:bad_amount' WHEN amount_cents = 0 THEN 'skip:zero_amount'
   WHEN account = '' THEN 'reject:no_account' WHEN currency <> 'EUR' THEN 'reject:foreign_currency'
   WHEN date = 'soon' THEN 'reject:bad_date' ELSE 'ok' END AS v FROM st3)"""

PLACES = ("'DUBLIN','CORK','GALWAY','LIMERICK','WATERFORD','KILKENNY','BRAY','SWORDS','TALLAGHT','DUNDRUM',"
          "'BLANCHARDSTOWN','MAYNOOTH','IE','IRL','IRELAND'")
DRESSED = r"""dressed AS (
 SELECT p_partkey, p_size, CASE
  WHEN p_size < 6 THEN 'sumup *' || p_name || ' Dublin 2'
  WHEN p_size < 11 THEN 'POS sq * ' || p_name || '  4368 CORK'
  WHEN p_size < 16 THEN 'VDP-' || split_part(p_name, ' ', -1) || ' galway'
  WHEN p_size < 21 THEN ' ' || p_name || ' { Type : x, At : 2026-05-04 }'
  WHEN p_size < 26 THEN p_name || ' 28jan 1/2/26 D04'
  WHEN p_size < 31 THEN 'Apple.com/bill ' || p_partkey
  WHEN p_size < 36 THEN ''
  WHEN p_size < 41 THEN 'zettle_PayPal *' || p_name || ' #12 IE'
  ELSE p_name END AS merchant_raw FROM part)"""


def keyed(source: str) -> str:
    """Merchant keys of the rows of `source`, by token lists instead of one pattern."""
    return rf"""k1 AS (SELECT *, trim(regexp_replace(upper(COALESCE(merchant_raw, '')), '\s+', ' ', 'g')) AS up FROM {source}),
k2 AS (SELECT *, CASE WHEN trim(split_part(up, '{{', 1)) <> '' THEN trim(split_part(up, '{{', 1)) ELSE up END AS nm FROM k1),
k3 AS (SELECT *, string_split(regexp_replace(nm, '^(?:(?:SUMUP|SQ|PAYPAL|GOOGLE|CRV)\s*\*\s*|ZETTLE_\s*|VD[PCA]-\s*|APPLE\.COM/BILL\s+|POS\s+)+(\S)', '\1'), ' ') AS t FROM k2),
k4 AS (SELECT *, array_to_string(t[1:list_max(list_transform(range(1, len(t) + 1), lambda i:
  CASE WHEN i > 1 AND regexp_full_match(t[i], '#?\d+|\d{{1,2}}[A-Z]{{3}}\d{{0,4}}|\d{{1,2}}/\d{{1,2}}(/\d{{2,4}})?|D\d{{1,2}}') THEN 0
       WHEN i > 2 AND t[i] IN ({PLACES}) THEN 0 ELSE i END))], ' ') AS kept FROM k3),
keyed AS (SELECT * EXCLUDE (up, nm, t, kept), CASE WHEN regexp_matches(kept, '[A-Z]') THEN kept ELSE nm END AS key FROM k4)"""


DRESSED_LEDGER = f"""{DRESSED},
dl AS (SELECT CAST(l_shipdate AS DATE) AS booking_date, merchant_raw FROM lineitem JOIN dressed ON l_partkey = p_partkey)"""

NAME_LABELS = """nl AS (
 SELECT DISTINCT CASE WHEN p_name LIKE 'hot %' THEN p_name ELSE upper(p_name) END AS merchant_key,
  CASE WHEN p_name LIKE 'red %' THEN 'Nonsense' WHEN p_name LIKE 'blue %' THEN 'Uncategorized'
   WHEN p_name LIKE 'small %' THEN 'Uncategorized' ELSE 'Gifts' END AS category,
  CASE WHEN p_name LIKE 'blue %' THEN 'manual' WHEN p_name LIKE 'small %' THEN 'dict'
   WHEN p_name LIKE '%gear%' THEN 'guess' ELSE 'regex' END AS "by",
  CASE WHEN p_name LIKE '%rod%' THEN 0.5::DOUBLE END AS confidence
 FROM part),
ok_labels AS (
 SELECT merchant_key, category AS label_category, CASE WHEN "by" = 'guess' THEN 'dict' ELSE "by" END AS label_by,
  confidence AS label_confidence
 FROM nl WHERE category <> 'Nonsense' AND (category <> 'Uncategorized' OR "by" = 'manual'))"""
CASCADE = f"""{HOUSEHOLD}, {NAME_LABELS},
dims AS (SELECT merchant_key, merchant_key AS k, min(booking_date) AS first_seen FROM sales
 WHERE merchant_key IS NOT NULL GROUP BY ALL),
ruled AS (SELECT *, {RULES} AS rule FROM dims),
casc AS (
 SELECT r.merchant_key, first_seen, COALESCE(label_category, rule, 'Uncategorized') AS category,
  CASE WHEN label_category IS NOT NULL THEN label_by WHEN rule IS NOT NULL THEN 'regex' END AS categorized_by,
  CASE WHEN label_category IS NOT NULL THEN label_confidence WHEN rule IS NOT NULL THEN 1.0::DOUBLE END AS confidence
 FROM ruled r LEFT JOIN ok_labels o ON r.merchant_key = o.merchant_key)"""

REQUESTS = f"""{EVENT},
rq0 AS (SELECT conv_id, turn, role, sha256(CAST(conv_id * 16 + turn AS VARCHAR)) AS ident FROM conversations),
rq AS (
 SELECT conv_id || '-' || turn AS request_id, role AS actor_id, turn,
  CASE turn WHEN 0 THEN ident[1:8] WHEN 1 THEN ident WHEN 2 THEN ident[1:5] WHEN 3 THEN upper(ident[1:12])
   ELSE ident[1:12] END AS ref,
  CASE role WHEN 'user' THEN 'Gifts' WHEN 'system' THEN 'nothing' ELSE 'Coffee/Snacks' END AS category FROM rq0),
found AS (
 SELECT ref, count(*) AS hits, min(id) AS txn_id, min(merchant_key) AS merchant_key
 FROM (SELECT DISTINCT ref FROM rq WHERE length(ref) >= 6) r JOIN ev ON starts_with(ev.id, r.ref) GROUP BY ref),
resolved AS (
 SELECT request_id, actor_id, turn, rq.ref, category,
  CASE WHEN category = 'nothing' THEN 'unknown_category' WHEN length(rq.ref) < 6 THEN 'too_short'
   WHEN hits IS NULL THEN 'not_found' WHEN hits > 1 THEN 'ambiguous' ELSE 'ok' END AS status, txn_id, merchant_key
 FROM rq LEFT JOIN found ON rq.ref = found.ref),
events_out AS (
 SELECT request_id || '|txn' AS event_id, actor_id, 'txn' AS scope, txn_id, NULL::VARCHAR AS merchant_key, category, turn
 FROM resolved WHERE status = 'ok'
 UNION ALL
 SELECT request_id || '|merchant', actor_id, 'merchant', NULL, merchant_key, category, turn FROM resolved WHERE status = 'ok')"""

FEED = """fd AS (
 SELECT *, CAST(user_id AS VARCHAR) AS account_id, strftime(ts, '%Y-%m-%d') AS day,
  CASE WHEN value BETWEEN 33 AND 36 THEN NULL ELSE CAST(round(value * 100) AS BIGINT) END AS size,
  CASE WHEN event_type = 'signup' THEN 1 WHEN event_type <> 'view' OR value < 10 THEN -1 END AS sign,
  CASE WHEN event_type = 'click' AND value > 5 THEN 'PDNG' WHEN event_type = 'click' THEN 'booked' END AS status_in,
  CASE WHEN value > 30 THEN 'USD' ELSE 'EUR' END AS currency,
  CASE WHEN value < 15 THEN 'paid ' || event_type ELSE event_type END AS text FROM events),
fd2 AS (
 SELECT *, CASE WHEN value < 40 THEN CASE WHEN value > 39 THEN '2024-13-01' ELSE day END
   WHEN value < 50 THEN day END AS booking_text FROM fd)"""


def overrides(day: int) -> str:
    """Logged paydays with the month they belong to; `day` is the scheduled day."""
    return f"""logged AS (
 SELECT CAST(o_custkey AS VARCHAR) AS account_id, o_orderkey, CAST(o_orderdate AS DATE) AS actual_date,
  CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders),
cand AS (
 SELECT logged.*, CAST(m + to_months(CAST(o AS INTEGER)) AS DATE) AS cm FROM logged, (VALUES (-1), (0), (1)) v(o)),
cand2 AS (
 SELECT *, abs(date_diff('day', least(CAST(cm + {day - 1} AS DATE), last_day(cm)), actual_date)) AS away FROM cand),
ov AS (
 SELECT account_id, o_orderkey, actual_date, cm AS cycle_month FROM cand2
 QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY away, cm) = 1),
latest_ov AS (SELECT account_id, cycle_month, arg_max(actual_date, o_orderkey) AS actual FROM ov GROUP BY ALL)"""


def calendar(first: str, last: str, day: int) -> str:
    return f"""{overrides(31)},
cal AS (
 SELECT a.account_id, CAST(m AS DATE) AS cycle_month,
  COALESCE(actual, least(CAST(CAST(m AS DATE) + {day - 1} AS DATE), last_day(CAST(m AS DATE)))) AS payday,
  CASE WHEN actual IS NULL THEN 'scheduled' ELSE 'logged' END AS payday_source
 FROM (SELECT CAST(c_custkey AS VARCHAR) AS account_id FROM customer) a
 CROSS JOIN (SELECT unnest(generate_series(DATE '{first}', DATE '{last}', INTERVAL 1 MONTH)) AS m) months
 LEFT JOIN latest_ov o ON o.account_id = a.account_id AND o.cycle_month = CAST(m AS DATE)),
cyc AS (
 SELECT * FROM (SELECT account_id, payday AS cycle_start, payday_source AS cycle_source,
  lead(payday) OVER (PARTITION BY account_id ORDER BY payday) AS next_payday
  FROM (SELECT * FROM cal QUALIFY row_number() OVER (PARTITION BY account_id, payday ORDER BY cycle_month DESC) = 1))
 WHERE next_payday IS NOT NULL)"""


def status(accounts: str, pool: int, cycles: str) -> str:
    """Account status from a table of current cycles named by `cycles`."""
    n = net(3_000_000)
    sums = ", ".join(
        f"CAST(COALESCE(sum(-amount_cents) FILTER ({n} AND ({BUCKET}) = '{b}'), 0) AS BIGINT) AS net_{b.lower()}_cents"
        for b in ("Income", "Transfers", "Fixed", "Groceries", "FoodDelivery", "Other"))
    return f"""status0 AS (
 SELECT {accounts} cycle_start, cycle_source, next_payday, CAST(date_diff('day', DATE '2001-06-30', next_payday) AS INTEGER) AS days_left, {sums},
  count(*) FILTER (amount_cents >= 3000000 AND category = 'Uncategorized') AS inflow_count,
  CAST(COALESCE(sum(amount_cents) FILTER (amount_cents >= 3000000 AND category = 'Uncategorized'), 0) AS BIGINT) AS inflow_cents
 FROM {cycles} GROUP BY ALL),
status1 AS (
 SELECT *, CAST({pool} AS BIGINT) AS pool_cents,
  net_groceries_cents + net_fooddelivery_cents + net_other_cents AS discretionary_cents,
  {pool} - (net_groceries_cents + net_fooddelivery_cents + net_other_cents) AS remaining_cents FROM status0),
status AS (
 SELECT *, greatest(0, remaining_cents // days_left) AS safe_today_cents,
  CASE WHEN greatest(0, remaining_cents // days_left) > 2500 THEN 'green'
   WHEN greatest(0, remaining_cents // days_left) < 1000 THEN 'red' ELSE 'amber' END AS light FROM status1)"""


POLICIES = f"""{EVENT},
pol AS (SELECT * FROM (VALUES (0, 'view-cap', 1500), (1, 'shop-cap', 4000), (2, 'misc-cap', 3000)) p(ord, policy, cap_cents)),
kept AS (SELECT *, CAST(date_trunc('month', booking_date) AS DATE) AS month FROM ev
 WHERE NOT (amount_cents >= 1000 AND category = 'Uncategorized')),
hits AS (
 SELECT e.*, ord, policy, cap_cents FROM kept e JOIN pol ON (ord = 0 AND category = 'FoodDelivery')
  OR (ord = 1 AND regexp_matches(merchant_key, '^(VIEW|PURCHASE) HOUSE$')) OR (ord = 2 AND ({BUCKET}) = 'Other'))"""


def progress(account: str = "account_id, ") -> str:
    return f"""prog AS (
 SELECT *, ord = min(ord) OVER (PARTITION BY id) AS is_first,
  CAST(sum(-amount_cents) OVER w AS BIGINT) AS mtd_cents,
  CAST(sum(CASE WHEN amount_cents < 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS charge_number
 FROM hits WINDOW w AS (PARTITION BY {account}ord, month ORDER BY booking_date, batch_ord ROWS UNBOUNDED PRECEDING)),
al AS (SELECT * FROM prog WHERE is_first AND amount_cents < 0 AND mtd_cents > cap_cents)"""


EUR = "CASE WHEN {0} < 0 THEN '-' ELSE '' END || '€' || format('{{:,}}', abs({0}) // 100) || '.' || lpad(CAST(abs({0}) % 100 AS VARCHAR), 2, '0')"
ORDINAL = ("CAST({0} AS VARCHAR) || CASE WHEN {0} % 100 BETWEEN 10 AND 20 THEN 'th' WHEN {0} % 10 = 1 THEN 'st' "
           "WHEN {0} % 10 = 2 THEN 'nd' WHEN {0} % 10 = 3 THEN 'rd' ELSE 'th' END")

BILLS = f"""{EVENT},
bill AS (SELECT * FROM (VALUES
  ('Groceries box', '^PURCHASE', DATE '2024-01-20', 900, 720, 1080), ('Viewing', '\\bHOUSE$', DATE '2024-01-24', 500, 250, 750),
  ('Old club', '^CLUB', DATE '2024-01-15', 1000, 900, 1100), ('Month end', '^CLICK', DATE '2023-12-31', 1200, 900, 1500))
  b(bill, pattern, due, expected_cents, low_cents, high_cents)),
paid AS (
 SELECT account_id, bill, booking_date AS paid_on, -amount_cents AS paid_cents FROM ev JOIN bill
  ON booking_date BETWEEN due - 5 AND DATE '2024-01-25' AND regexp_matches(merchant_key, pattern)
 WHERE amount_cents < 0
 QUALIFY row_number() OVER (PARTITION BY account_id, bill ORDER BY booking_date DESC, batch_ord DESC) = 1),
state AS (
 SELECT a.account_id, b.*, paid_on, paid_cents, date_diff('day', due, DATE '2024-01-25') AS days_past_due,
  paid_on IS NULL AND date_diff('day', due, DATE '2024-01-25') > 3 AS overdue
 FROM (SELECT DISTINCT account_id FROM ev) a CROSS JOIN bill b
 LEFT JOIN paid p ON p.account_id = a.account_id AND p.bill = b.bill)"""

RECURRING = f"""{EVENT},
ch AS (SELECT account_id, merchant_key, booking_date, -amount_cents AS spend,
  date_diff('day', lag(booking_date) OVER (PARTITION BY account_id, merchant_key ORDER BY booking_date, batch_ord), booking_date) AS gap
 FROM ev WHERE amount_cents < 0),
med AS (
 SELECT account_id, merchant_key, count(*) AS occurrences, max(booking_date) AS last_day,
  stddev_pop(spend) / avg(spend) AS cv, quantile_disc(spend, 0.5) AS amount_cents, quantile_disc(gap, 0.5) AS interval_days
 FROM ch GROUP BY ALL),
seen AS (SELECT account_id, merchant_key, min(booking_date) AS first_seen FROM ev GROUP BY ALL),
dev AS (
 SELECT c.account_id, c.merchant_key, quantile_disc(abs(gap - interval_days), 0.5) AS mad
 FROM ch c JOIN med m ON c.account_id = m.account_id AND c.merchant_key = m.merchant_key WHERE gap IS NOT NULL GROUP BY ALL),
rec AS (
 SELECT m.account_id, m.merchant_key, CASE WHEN interval_days BETWEEN 28 AND 32 THEN 'monthly' ELSE 'weekly' END AS period,
  CAST(interval_days AS INTEGER) AS interval_days, CAST(last_day + CAST(interval_days AS INTEGER) AS DATE) AS next_expected, first_seen, occurrences, amount_cents,
  amount_cents * CASE WHEN interval_days BETWEEN 28 AND 32 THEN 12 ELSE 52 END AS annualized_cents
 FROM med m JOIN dev d ON m.account_id = d.account_id AND m.merchant_key = d.merchant_key
 JOIN seen s ON m.account_id = s.account_id AND m.merchant_key = s.merchant_key
 WHERE occurrences >= 3 AND cv < 1.2 AND mad <= 3 AND (interval_days BETWEEN 28 AND 32 OR interval_days BETWEEN 2 AND 8)
  AND last_day + CAST(interval_days AS INTEGER) >= DATE '2024-01-25' - CAST(interval_days AS INTEGER))"""


def reconciliation(keys: str, window: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    head = f"{keys}, " if keys else ""
    fixed = "category IN ('Rent','Utilities','Tools','Health/Fitness','Subscriptions','Fees')"

    def total(condition: str, sign: str = "-") -> str:
        return f"CAST(COALESCE(sum({sign}amount_cents) FILTER ({condition}), 0) AS BIGINT)"

    return f"""m0 AS (
 SELECT {head}CAST(date_trunc('month', booking_date) AS DATE) AS first,
  {total("amount_cents > 0 AND category IN ('Income','Transfers')", "")} AS inflows_cents,
  {total(f"amount_cents < 0 AND {fixed}")} AS fixed_cents,
  {total(f"{GROSS} AND category <> 'Uncategorized' AND NOT {fixed}")} AS variable_cents,
  {total("amount_cents < 0 AND category = 'Uncategorized'")} AS uncategorized_cents,
  {total("amount_cents < 0 AND category = 'Transfers'")} AS transfers_out_cents,
  {total("amount_cents > 0 AND category NOT IN ('Income','Transfers')", "")} AS refunds_in_cents,
  {total("amount_cents < 0 AND category = 'Income'")} AS income_out_cents,
  CAST(sum(amount_cents) AS BIGINT) AS net_cents, min(booking_date) AS lo, max(booking_date) AS hi
 FROM hh WHERE {window} GROUP BY ALL),
rc AS (
 SELECT {head}strftime(first, '%Y-%m') AS month, inflows_cents, fixed_cents, variable_cents, uncategorized_cents,
  transfers_out_cents, refunds_in_cents, income_out_cents, net_cents,
  first >= min(lo) OVER ({part}) AND last_day(first) <= max(hi) OVER ({part}) AS full_month,
  inflows_cents - fixed_cents - variable_cents AS residual_cents,
  abs(inflows_cents - fixed_cents - variable_cents) < 20000 AS gate_pass FROM m0)"""


def pareto(keys: str, window: str) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    head = f"{keys}, " if keys else ""
    return f"""WITH {HOUSEHOLD},
c AS (SELECT {head}category, CAST(sum(-amount_cents) AS BIGINT) AS spend_cents, count(*) AS txns
 FROM hh WHERE {GROSS} AND {window} GROUP BY ALL)
SELECT *, row_number() OVER ({part}ORDER BY spend_cents DESC, category) AS rank,
 round(100.0::DOUBLE * spend_cents / sum(spend_cents) OVER ({part}), 6) AS pct,
 round(100.0::DOUBLE * sum(spend_cents) OVER ({part}ORDER BY spend_cents DESC, category ROWS UNBOUNDED PRECEDING)
  / sum(spend_cents) OVER ({part}), 6) AS cum_pct FROM c"""


def merchant_pareto(keys: str, top: int) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    head = f"{keys}, " if keys else ""
    return f"""WITH {HOUSEHOLD},
c AS (SELECT {head}COALESCE(merchant_key, '(unlinked)') AS merchant, category, sum(-amount_cents) AS s, count(*) AS n
 FROM hh WHERE {GROSS} AND {LONG} GROUP BY ALL),
m AS (SELECT {head}merchant, first(category ORDER BY n DESC, category) AS category,
 CAST(sum(s) AS BIGINT) AS spend_cents, CAST(sum(n) AS BIGINT) AS txns FROM c GROUP BY {head}merchant)
SELECT *, CAST(row_number() OVER ({part}ORDER BY spend_cents DESC, merchant) AS INTEGER) AS rank,
 round(100.0::DOUBLE * spend_cents / sum(spend_cents) OVER ({part}), 6) AS pct FROM m
QUALIFY row_number() OVER ({part}ORDER BY spend_cents DESC, merchant) <= {top}"""


def bucket_table(source: str, window: str, threshold: int, accounts: str = "") -> str:
    """Net spend per account and bucket with zero rows, as a relation."""
    return f"""(SELECT a.account_id, b.bucket, CAST(COALESCE(s, 0) AS BIGINT) AS cents
 FROM ({accounts or f"SELECT DISTINCT account_id FROM {source}"}) a CROSS JOIN {BUCKET_ROWS}
 LEFT JOIN (SELECT account_id, {BUCKET} AS bucket, sum(-amount_cents) AS s FROM {source}
  WHERE {window} AND {net(threshold)} GROUP BY ALL) x ON x.account_id = a.account_id AND x.bucket = b.bucket)"""


DIGEST = f"""{EVENT},
wk AS {bucket_table("ev", "booking_date BETWEEN DATE '2024-01-19' AND DATE '2024-01-25'", 1_000)},
pv AS {bucket_table("ev", "booking_date BETWEEN DATE '2024-01-12' AND DATE '2024-01-18'", 1_000)},
dg AS (
 SELECT wk.account_id, wk.bucket, wk.cents AS week_cents, pv.cents AS prev_cents, wk.cents - pv.cents AS delta_cents,
  CAST(sum(greatest(wk.cents, 0)) OVER (PARTITION BY wk.account_id) AS BIGINT) AS week_total_cents,
  CAST(sum(greatest(pv.cents, 0)) OVER (PARTITION BY wk.account_id) AS BIGINT) AS prev_total_cents
 FROM wk JOIN pv ON wk.account_id = pv.account_id AND wk.bucket = pv.bucket
 WHERE wk.account_id IN (SELECT account_id FROM ev WHERE booking_date BETWEEN DATE '2024-01-12' AND DATE '2024-01-25'))"""

CURSOR = """cur AS (
 SELECT CAST(o_custkey AS VARCHAR) AS account_id, max(CAST(o_orderdate AS DATE)) AS high_water,
  CAST(min(CAST(o_orderdate AS DATE)) + 200 AS DATE) AS coverage_start FROM orders GROUP BY ALL)"""
CLIP = f"""{HOUSEHOLD}, {CURSOR},
lo AS (SELECT account_id, min(booking_date) AS d FROM sales GROUP BY ALL),
bnd AS (SELECT lo.account_id, CASE WHEN d < coverage_start THEN coverage_start ELSE d END AS clip_before
 FROM lo LEFT JOIN cur ON lo.account_id = cur.account_id)"""


RULE_TABLE = """words AS (
 SELECT DISTINCT upper(unnest(regexp_extract_all(text, '[A-Za-z]{4,}'))) AS word FROM benchmark),
numbered AS (SELECT word, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) AS ord FROM words),
rules AS (SELECT ord, CASE WHEN ord % 16 = 5 THEN substr(word, 1, 2) || '[.]?$'
  WHEN ord % 4 = 0 THEN '(^| )' || word || '( |[.,])' WHEN ord % 4 = 1 THEN word
  WHEN ord % 4 = 2 THEN '^' || word || '|' || word || ' ?$' ELSE '(' || word || '|XYZ' || word || ')E?[.,]' END AS pattern,
  CASE ord % 3 WHEN 0 THEN 'Gifts' WHEN 1 THEN 'Travel' ELSE 'Cash' END AS category FROM numbered),
spoken AS (SELECT DISTINCT translate(text, 'abcdefghijklmnopqrstuvwxyz' || chr(10), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ ') AS k FROM conversations),
pairs AS (SELECT k, rules.* FROM spoken JOIN rules ON regexp_matches(k, pattern))"""

OWN_POLICIES = f"""{EVENT}, own AS (
 SELECT CAST(c_custkey AS VARCHAR) AS account_id, ord, policy, CASE ord WHEN 0 THEN 500 + c_custkey % 7 * 300
   WHEN 1 THEN 1000 + c_custkey % 5 * 500 WHEN 2 THEN 2000 ELSE 1500 END AS cap_cents,
  CASE c_custkey % 3 WHEN 0 THEN 'Groceries' WHEN 1 THEN 'FoodDelivery' ELSE 'Coffee/Snacks' END AS own_label,
  CASE WHEN ord = 3 THEN 'E$' WHEN c_custkey % 2 = 0 THEN '^(VIEW|PURCHASE) HOUSE$' ELSE 'CLICK|SIGNUP HOUSE$' END AS own_pattern
 FROM customer, (VALUES (0, 'label-cap'), (1, 'name-cap'), (2, 'bucket-cap'), (3, 'tail-cap')) p(ord, policy)
 WHERE ord < 2 OR (ord = 2 AND c_custkey % 4 <> 1) OR (ord = 3 AND c_custkey % 5 = 0)),
kept AS (SELECT *, CAST(date_trunc('month', booking_date) AS DATE) AS month FROM ev
 WHERE NOT (amount_cents >= {{threshold}} AND category = 'Uncategorized')),
hits AS (SELECT e.*, ord, policy, cap_cents FROM kept e JOIN own USING (account_id) WHERE CASE ord WHEN 0 THEN category = own_label
  WHEN 2 THEN {BUCKET} = 'Other' ELSE regexp_matches(merchant_key, own_pattern) END)"""

OWN_BILLS = f"""{EVENT}, days AS (SELECT * FROM (VALUES (DATE '2024-01-10'), (DATE '2024-01-25'), (DATE '2024-01-31')) d(as_of)),
own AS (SELECT CAST(c_custkey AS VARCHAR) AS account_id, bill, as_of,
  CASE bill WHEN 'Box' THEN '^PURCHASE' WHEN 'View' THEN '\\bHOUSE$' ELSE '[KW] HOUS?E$' END AS pattern,
  CASE bill WHEN 'Box' THEN c_custkey % 31 + 1 WHEN 'View' THEN 31 ELSE 5 END AS due_day,
  CASE bill WHEN 'Box' THEN 900 + c_custkey % 10 * 50 WHEN 'View' THEN 500 ELSE 1000 END AS expected_cents,
  CASE bill WHEN 'Box' THEN 20 WHEN 'View' THEN 50 ELSE 10 END AS tolerance
 FROM customer, days, (VALUES ('Box'), ('View'), ('Any')) b(bill)
 WHERE bill = 'Box' OR (bill = 'View' AND c_custkey % 2 = 0) OR (bill = 'Any' AND c_custkey % 3 = 0)),
dated AS (SELECT *, CAST(date_trunc('month', as_of) AS DATE) AS first, CAST(date_trunc('month', as_of) - INTERVAL 1 MONTH AS DATE) AS earlier FROM own),
dued AS (SELECT *, first + CAST(least(due_day, day(last_day(first))) AS INTEGER) - 1 AS this,
  earlier + CAST(least(due_day, day(last_day(earlier))) AS INTEGER) - 1 AS prior FROM dated),
own_due AS (SELECT *, CASE WHEN this <= as_of THEN this ELSE prior END AS due FROM dued),
paid AS (SELECT o.account_id, bill, as_of, booking_date AS paid_on, -amount_cents AS paid_cents FROM own_due o JOIN ev
  ON ev.account_id = o.account_id AND amount_cents < 0 AND booking_date BETWEEN due - 5 AND as_of AND regexp_matches(merchant_key, pattern)
 QUALIFY row_number() OVER (PARTITION BY o.account_id, bill, as_of ORDER BY booking_date DESC, batch_ord DESC) = 1),
state AS (SELECT o.account_id, bill, as_of, due, CAST(expected_cents AS BIGINT) AS expected_cents,
  CAST(expected_cents * (100 - tolerance) // 100 AS BIGINT) AS low_cents, CAST(expected_cents * (100 + tolerance) // 100 AS BIGINT) AS high_cents,
  paid_on, paid_cents, CAST(date_diff('day', due, as_of) AS INTEGER) AS days_past_due, paid_on IS NULL AND date_diff('day', due, as_of) > 3 AS overdue
 FROM own_due o LEFT JOIN paid USING (account_id, bill, as_of))"""

ORACLES = {
    # ── ingest ──
    "money_parse": f"""WITH {STATEMENT},
t AS (SELECT l_orderkey, l_linenumber, l_partkey, debit || credit AS text,
 CASE WHEN debit <> '' AND credit <> '' THEN
   TRY_CAST(CASE WHEN regexp_full_match(trim(replace(debit || credit, '€', '')), '\\d+(\\.\\d{{1,2}})?|\\d{{1,3}}(,\\d{{3}})+(\\.\\d{{1,2}})?')
     THEN replace(trim(replace(debit || credit, '€', '')), ',', '') END AS DECIMAL(18,2)) * 100
  WHEN debit || credit = '' THEN NULL ELSE cents END AS c FROM st2)
SELECT l_orderkey, l_linenumber, l_partkey, text, CAST(c AS BIGINT) AS cents, {EUR.format("CAST(c AS BIGINT)")} AS eur,
 CAST(CAST(c AS BIGINT) // 100 AS VARCHAR) || '.' || lpad(CAST(CAST(c AS BIGINT) % 100 AS VARCHAR), 2, '0') AS plain,
 {ORDINAL.format("l_orderkey")} AS place FROM t""",
    "date_parse": f"WITH {STATEMENT} SELECT l_orderkey, l_linenumber, l_partkey, date, CASE WHEN date <> 'soon' THEN day END AS parsed FROM st",
    "statement_map": f"""WITH {STATEMENT}
SELECT l_orderkey, l_linenumber, l_partkey, CASE account WHEN 'ACC-1-URGENT' THEN 'main' WHEN 'ACC-5-LOW' THEN 'spare' ELSE account END AS account_id,
 CASE WHEN date <> 'soon' THEN day END AS booking_date, amount_cents, currency, text AS merchant_raw,
 split_part(v, ':', 1) AS status, NULLIF(split_part(v, ':', 2), '') AS reason FROM verdict""",
    "feed_map": f"""WITH {FEED}
SELECT event_id AS batch_ord, CASE WHEN value > 1 THEN 'ref-' || event_id END AS id, account_id,
 TRY_CAST(booking_text AS DATE) AS booking_date, CASE WHEN value < 50 THEN CAST(day AS DATE) END AS value_date,
 sign * size AS amount_cents, currency, COALESCE(CASE WHEN event_type <> 'error' THEN event_type || ' shop' END, text) AS merchant_raw,
 text AS description,
 CASE WHEN status_in = 'PDNG' OR booking_text IS NULL THEN 'skip' WHEN size IS NULL OR sign IS NULL OR currency <> 'EUR'
   OR TRY_CAST(booking_text AS DATE) IS NULL THEN 'reject' ELSE 'ok' END AS status,
 CASE WHEN status_in = 'PDNG' THEN 'not_booked' WHEN booking_text IS NULL THEN 'no_date' WHEN size IS NULL THEN 'bad_amount'
  WHEN sign IS NULL THEN 'no_direction' WHEN currency <> 'EUR' THEN 'foreign_currency'
  WHEN TRY_CAST(booking_text AS DATE) IS NULL THEN 'bad_date' END AS reason FROM fd2""",
    "booked_rows": f"WITH {FEED} SELECT event_id AS batch_ord, COALESCE(status_in, 'none') AS status FROM fd WHERE COALESCE(status_in, '') <> 'PDNG'",
    "row_contract": """WITH r AS (
 SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity <> 3 THEN CAST(round(l_extendedprice * 100) AS BIGINT) END AS amount_cents,
  CASE WHEN l_quantity <> 7 THEN CAST(l_shipdate AS DATE) END AS booking_date,
  CASE l_returnflag WHEN 'R' THEN 'manual' WHEN 'A' THEN 'csv' ELSE 'api' END AS source,
  CASE WHEN l_linenumber = 7 THEN '' ELSE CAST(l_suppkey AS VARCHAR) END AS account_id, 'EUR' AS currency FROM lineitem),
v AS (SELECT *, CASE WHEN amount_cents IS NULL THEN 'bad_amount' WHEN booking_date IS NULL THEN 'bad_date'
 WHEN source = 'manual' THEN 'bad_source' WHEN account_id = '' THEN 'no_account' END AS reason FROM r)
SELECT *, CASE WHEN reason IS NULL THEN 'ok' ELSE 'reject' END AS status FROM v""",
    "currency_gate": f"""WITH {FEED} SELECT event_id AS batch_ord, CASE WHEN currency = 'EUR' THEN 'ok' ELSE 'reject' END AS status,
 CASE WHEN currency <> 'EUR' THEN 'foreign_currency' END AS reason FROM fd""",
    "account_labels": """SELECT o_orderkey, o_orderpriority AS account_label,
 CASE WHEN o_orderpriority < '4' THEN 'acc-' || o_orderpriority[1:1] ELSE o_orderpriority END AS account_id FROM orders""",
    "feed_rejects": f"""WITH {FEED}, r AS (
SELECT event_id AS batch_ord, CASE WHEN event_id % 7 = 0 THEN 'unreadable' WHEN status_in = 'PDNG' OR booking_text IS NULL THEN NULL
  WHEN size IS NULL THEN 'bad_amount' WHEN sign IS NULL THEN 'no_direction' WHEN event_type = 'purchase' THEN 'no_account'
  WHEN currency <> 'EUR' THEN 'foreign_currency' WHEN TRY_CAST(booking_text AS DATE) IS NULL THEN 'bad_date' END AS reason,
 CASE WHEN event_id % 7 = 0 THEN '{{"account_id": "' || event_id END AS raw FROM fd2)
SELECT * FROM r WHERE reason IS NOT NULL""",
    "long_names": f"""WITH dt AS (SELECT doc_id, 'POS ' || replace(COALESCE(text, ''), 'ß', 'ss') || ' 123 CORK D2' AS merchant_raw FROM documents), {keyed("dt")}
SELECT doc_id, CAST(length(key) AS INTEGER) AS key_chars, md5(key) AS key_md5 FROM keyed""",
    "row_ids": """WITH r AS (
 SELECT CASE WHEN l_linestatus = 'O' AND l_linenumber = 7 THEN 'bank-' || l_orderkey END AS ref,
  CAST(date_trunc('month', l_shipdate) AS DATE) AS booking_date, -CAST(l_quantity * 100 AS BIGINT) AS amount_cents,
  CASE WHEN p_brand <> 'Brand#13' THEN split_part(p_name, ' ', -1) END AS merchant_raw, l_linestatus AS account_id,
  l_returnflag AS batch_id, l_orderkey * 8 + l_linenumber AS o
 FROM lineitem JOIN part ON l_partkey = p_partkey),
n AS (SELECT *, concat_ws('|', booking_date, amount_cents, COALESCE(merchant_raw, ''), account_id) AS base,
 row_number() OVER (PARTITION BY ref IS NULL, batch_id, booking_date, amount_cents, COALESCE(merchant_raw, ''), account_id ORDER BY o) - 1 AS occ FROM r)
SELECT COALESCE(ref, sha256(CASE WHEN occ > 0 THEN base || '|' || occ ELSE base END)) AS id, booking_date, amount_cents, merchant_raw,
 account_id, batch_id FROM n""",
    "row_ids_hot": """WITH r AS (
 SELECT CASE WHEN l_linestatus = 'O' AND l_linenumber = 7 THEN 'bank-' || l_orderkey END AS ref,
  CAST(date_trunc('month', l_shipdate) AS DATE) AS booking_date, -CAST(l_quantity * 100 AS BIGINT) AS amount_cents,
  CASE WHEN p_brand <> 'Brand#13' THEN split_part(p_name, ' ', -1) END AS merchant_raw, l_linestatus AS account_id,
  nullif(l_returnflag, 'N') AS batch_id, l_orderkey * 8 + l_linenumber AS o
 FROM lineitem JOIN part ON l_partkey = p_partkey),
n AS (SELECT *, concat_ws('|', booking_date, amount_cents, COALESCE(merchant_raw, ''), account_id) AS base,
 row_number() OVER (PARTITION BY ref IS NULL, batch_id, booking_date, amount_cents, COALESCE(merchant_raw, ''), account_id ORDER BY o) - 1 AS occ FROM r)
SELECT COALESCE(ref, sha256(CASE WHEN occ > 0 THEN base || '|' || occ ELSE base END)) AS id, booking_date, amount_cents, merchant_raw,
 account_id, batch_id FROM n""",
    "append_once": """WITH r AS (
 SELECT l_orderkey || '-' || l_linenumber AS id, CAST(l_shipdate AS DATE) AS booking_date, l_linestatus,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_cents,
  strftime(l_shipdate, '%Y-%m-%d') || '/' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS batch_id,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS batch_ord FROM lineitem)
SELECT id, booking_date, amount_cents, batch_id, batch_ord FROM r
WHERE l_linestatus = 'O' AND id NOT IN (SELECT id FROM r WHERE l_linestatus = 'F')
QUALIFY row_number() OVER (PARTITION BY id ORDER BY batch_id, batch_ord) = 1""",
    "quarantine_rows": f"""WITH {STATEMENT},
b AS (SELECT DISTINCT 'csv' AS source, split_part(v, ':', 2) AS reason,
 '{{"account":"' || CASE WHEN q = 13 THEN ' ' ELSE account END || '","credit":"' || credit || '","date":"' || date || '","debit":"' || debit || '"}}' AS raw FROM verdict WHERE v LIKE 'reject%')
SELECT source, reason, raw, sha256('csv|' || raw) AS fingerprint FROM b QUALIFY row_number() OVER (PARTITION BY raw ORDER BY reason) = 1""",
    "quarantine_counts": f"""WITH {STATEMENT},
b AS (SELECT concat_ws('~', CASE WHEN q = 13 THEN ' ' ELSE account END, credit, date, debit, text) AS raw, min(split_part(v, ':', 2)) AS reason FROM verdict WHERE v LIKE 'reject%' GROUP BY 1)
SELECT 'csv' AS source, reason, count(*) AS rows FROM b GROUP BY ALL""",
    "clip_dates": f"WITH {CLIP} SELECT * FROM bnd",
    "clip_statements": f"""WITH {CLIP} SELECT i.id, i.account_id, i.booking_date, COALESCE(i.booking_date >= clip_before, FALSE) AS clipped
FROM income i LEFT JOIN bnd ON i.account_id = bnd.account_id""",
    "clip_statements_whole": f"""WITH {CLIP} SELECT id, account_id, booking_date, booking_date >= (SELECT CASE WHEN min(d) < (SELECT min(coverage_start) FROM cur)
 THEN (SELECT min(coverage_start) FROM cur) ELSE min(d) END FROM lo) AS clipped FROM income""",
    "cursor_advance": f"""WITH {HOUSEHOLD}, {CURSOR},
seen AS (SELECT account_id, max(booking_date) AS s FROM sales GROUP BY ALL),
pull AS (SELECT CAST(c_custkey AS VARCHAR) AS account_id, c_mktsegment = 'BUILDING' AS cut FROM customer)
SELECT COALESCE(cur.account_id, pull.account_id) AS account_id,
 CASE WHEN COALESCE(cut, FALSE) THEN high_water ELSE greatest(high_water, s) END AS high_water,
 CASE WHEN high_water IS NULL THEN CASE WHEN cut IS NOT NULL THEN DATE '1996-01-01' END ELSE coverage_start END AS coverage_start
FROM cur FULL JOIN pull ON cur.account_id = pull.account_id LEFT JOIN seen ON seen.account_id = COALESCE(cur.account_id, pull.account_id)""",
    "next_pull": f"WITH {CURSOR} SELECT *, CAST(high_water - 5 AS DATE) AS since FROM cur",
    "ingest_counts": f"""WITH {STATEMENT},
b AS (SELECT account, min(day) AS d FROM verdict WHERE v = 'ok' AND day >= DATE '2000-01-01' GROUP BY ALL),
clip AS (SELECT verdict.* REPLACE (CASE WHEN v = 'ok' AND day >= d THEN 'clipped' ELSE v END AS v) FROM verdict LEFT JOIN b ON verdict.account = b.account),
f AS (SELECT file_path FROM clip WHERE v = 'ok' QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY batch_ord, file_path, l_partkey) = 1),
n AS (SELECT file_path, count(*) AS c FROM f GROUP BY ALL),
s AS (SELECT file_path, count(*) FILTER (v = 'ok') AS submitted, count(*) FILTER (v LIKE 'skip%') AS skipped,
 count(*) FILTER (v LIKE 'reject%') AS quarantined, count(*) FILTER (v = 'clipped') AS clipped FROM clip GROUP BY ALL)
SELECT s.*, COALESCE(c, 0) AS new, submitted - COALESCE(c, 0) AS duplicate FROM s LEFT JOIN n ON s.file_path = n.file_path""",
    "combined_sources": f"""WITH {HOUSEHOLD} SELECT batch_id, id, account_id,
 CASE WHEN batch_id = 'income' THEN merchant_key END AS merchant_key, amount_cents FROM hh""",
    # ── merchants and categories ──
    "merchant_names": f"""WITH {DRESSED}, {keyed("dressed")}
SELECT p_partkey, p_size, merchant_raw, key AS merchant_key, trim(split_part(merchant_raw, '{{', 1)) AS shown,
 trim(regexp_replace(upper(trim(split_part(merchant_raw, '{{', 1))), '\\s+', ' ', 'g')) AS identity FROM keyed""",
    "merchant_dimension": f"""WITH {DRESSED_LEDGER}, {keyed("dl")}
SELECT key AS merchant_key, min(booking_date) AS first_seen FROM keyed WHERE key <> '' GROUP BY ALL""",
    "name_collisions": f"""WITH {DRESSED_LEDGER}, {keyed("dl")},
i AS (SELECT DISTINCT key AS merchant_key, trim(regexp_replace(upper(trim(split_part(merchant_raw, '{{', 1))), '\\s+', ' ', 'g')) AS name FROM keyed WHERE key <> '')
SELECT merchant_key, count(*) AS names, min(name) AS first_name, max(name) AS last_name FROM i GROUP BY ALL HAVING count(*) > 1""",
    "stale_labels": f"WITH {NAME_LABELS} SELECT * FROM nl WHERE merchant_key <> upper(merchant_key)",
    "rule_table_matches": f"""WITH {RULE_TABLE} SELECT md5(k) AS key_md5,
 coalesce(min_by(category, (ord, pattern)), 'Uncategorized') AS category, CASE WHEN count(ord) > 0 THEN 'regex' END AS categorized_by
 FROM spoken LEFT JOIN pairs USING (k) GROUP BY k""",
    "rule_table_pairs": f"WITH {RULE_TABLE} SELECT ord, count(*) AS names FROM pairs GROUP BY ord",
    "rule_matches": f"SELECT k AS merchant_key, {RULES} AS category FROM (SELECT DISTINCT upper(p_name) AS k FROM part)",
    "label_validity": f"WITH {NAME_LABELS} SELECT * FROM ok_labels",
    "cascade": f"WITH {CASCADE} SELECT * FROM casc",
    "cascade_counts": f"WITH {CASCADE} SELECT COALESCE(categorized_by, 'unresolved') AS tier, count(*) AS merchants FROM casc GROUP BY ALL",
    "effective_categories": f"""WITH {CASCADE},
e AS (SELECT id, s.merchant_key, CASE WHEN abs(amount_cents) > 9500000 THEN 'Dates' ELSE COALESCE(c.category, 'Uncategorized') END AS category
 FROM sales s LEFT JOIN casc c ON s.merchant_key = c.merchant_key) SELECT *, {BUCKET} AS bucket FROM e""",
    "bucket_rollup": f"WITH {HOUSEHOLD} SELECT {BUCKET} AS bucket, category, count(*) AS rows, CAST(sum(amount_cents) AS BIGINT) AS cents FROM hh GROUP BY ALL",
    "category_coverage": f"""WITH {HOUSEHOLD}, r AS (SELECT * FROM hh WHERE booking_date >= DATE '2001-06-30' - 90)
SELECT a.account_id, count(r.id) AS window_txns,
 COALESCE(round(100.0::DOUBLE * count(r.id) FILTER (category <> 'Uncategorized') / NULLIF(count(r.id), 0), 6), 100) AS count_pct,
 COALESCE(round(100.0::DOUBLE * COALESCE(sum(abs(amount_cents)) FILTER (category <> 'Uncategorized'), 0) / NULLIF(sum(abs(amount_cents)), 0), 6), 100) AS value_pct
FROM ({ACCOUNTS} UNION SELECT account_id FROM r) a LEFT JOIN r ON r.account_id = a.account_id GROUP BY a.account_id""",
    "category_coverage_whole": f"""WITH {HOUSEHOLD} SELECT count(*) AS window_txns,
 round(100.0::DOUBLE * count(*) FILTER (category <> 'Uncategorized') / count(*), 6) AS count_pct,
 round(100.0::DOUBLE * sum(abs(amount_cents)) FILTER (category <> 'Uncategorized') / sum(abs(amount_cents)), 6) AS value_pct
FROM hh WHERE booking_date >= DATE '2001-06-30' - 3650""",
    "relabel_requests": f"""WITH {REQUESTS} SELECT request_id, actor_id, ref, category, status,
 CASE WHEN status = 'ok' THEN txn_id END AS txn_id, CASE WHEN status = 'ok' THEN merchant_key END AS merchant_key FROM resolved""",
    "relabel_events": f"WITH {REQUESTS} SELECT event_id, actor_id, scope, txn_id, merchant_key, category FROM events_out WHERE actor_id <> 'system'",
    "latest_labels": f"""WITH {REQUESTS} SELECT merchant_key, category, 'manual' AS "by" FROM events_out WHERE scope = 'merchant'
QUALIFY row_number() OVER (PARTITION BY merchant_key ORDER BY turn DESC, event_id DESC) = 1""",
    "latest_overrides": f"""WITH {REQUESTS} SELECT txn_id, category FROM events_out WHERE scope = 'txn'
QUALIFY row_number() OVER (PARTITION BY txn_id ORDER BY turn DESC, event_id DESC) = 1""",
    "corrected_months": f"""WITH {REQUESTS},
named AS (SELECT merchant_key, category AS label FROM events_out WHERE scope = 'merchant' AND turn < 3
 QUALIFY row_number() OVER (PARTITION BY merchant_key ORDER BY turn DESC, event_id DESC) = 1),
own AS (SELECT txn_id AS id, category AS override FROM events_out WHERE scope = 'txn'
 QUALIFY row_number() OVER (PARTITION BY txn_id ORDER BY turn DESC, event_id DESC) = 1),
sorted AS (SELECT account_id, strftime(booking_date, '%Y-%m') AS booking_month, amount_cents, coalesce(override, label,
  CASE WHEN merchant_key LIKE 'VIEW%' THEN 'FoodDelivery' WHEN merchant_key LIKE 'PURCHASE%' THEN 'Groceries' ELSE 'Shopping' END) AS category
 FROM ev LEFT JOIN named USING (merchant_key) LEFT JOIN own USING (id))
SELECT account_id, booking_month, category, count(*) AS bookings, CAST(sum(amount_cents) AS BIGINT) AS cents,
 count(*) FILTER (amount_cents < 0) AS charges, CAST(coalesce(sum(-amount_cents) FILTER (amount_cents < 0), 0) AS BIGINT) AS charged_cents FROM sorted GROUP BY ALL""",
    "single_overrides": f"""WITH {REQUESTS} SELECT request_id || '|txn' AS event_id, actor_id, 'txn' AS scope, txn_id, NULL::VARCHAR AS merchant_key, 'Dates' AS category
FROM resolved WHERE length(ref) >= 6 AND txn_id IS NOT NULL AND ref IN (SELECT ref FROM found WHERE hits = 1)""",
    "name_lookup": """SELECT event_id, CASE event_type WHEN 'view' THEN ' MISC. ' WHEN 'click' THEN 'coffee/SNACKS' WHEN 'error' THEN 'food delivery'
 WHEN 'signup' THEN 'other' ELSE 'fixed' END AS name, CASE event_type WHEN 'click' THEN 'Coffee/Snacks' WHEN 'signup' THEN 'Other' END AS category,
 CASE event_type WHEN 'view' THEN 'Other' WHEN 'error' THEN 'FoodDelivery' WHEN 'purchase' THEN 'Fixed' END AS bucket FROM events""",
    # ── spend ──
    "gross_spend": f"WITH {HOUSEHOLD} SELECT id, account_id, booking_date, amount_cents, category FROM hh WHERE {GROSS} AND {WINDOW}",
    "net_scope": f"WITH {HOUSEHOLD} SELECT id, booking_date, amount_cents, category FROM hh WHERE {net(3_000_000)} AND {WINDOW}",
    "trailing_rows": f"WITH {HOUSEHOLD} SELECT id, booking_date, amount_cents FROM hh WHERE booking_date >= DATE '2001-06-30' - 90 AND booking_date <= DATE '2001-06-30'",
    "category_pareto": pareto("account_id", LONG),
    "category_pareto_whole": pareto("", WINDOW),
    "merchant_pareto": merchant_pareto("account_id", 3),
    "merchant_pareto_whole": merchant_pareto("", 25),
    "size_bands": f"""WITH {EVENT}, bands AS (SELECT * FROM (VALUES ('<€5', 0, 500), ('€5–15', 500, 1500), ('€15–40', 1500, 4000),
 ('€40–100', 4000, 10000), ('>€100', 10000, 9223372036854775807)) b(band, lo, hi)),
a AS (SELECT account_id FROM ev WHERE {EVENTS} UNION {ACCOUNTS}), g AS (SELECT * FROM ev WHERE {EVENTS} AND {GROSS})
SELECT a.account_id, band, count(g.id) AS count, CAST(COALESCE(sum(-amount_cents), 0) AS BIGINT) AS total_cents
FROM a CROSS JOIN bands LEFT JOIN g ON g.account_id = a.account_id AND -amount_cents >= lo AND -amount_cents < hi GROUP BY a.account_id, band""",
    "weekday_profile": f"""WITH {HOUSEHOLD}, days AS (SELECT * FROM (VALUES ('Mon', 1), ('Tue', 2), ('Wed', 3), ('Thu', 4), ('Fri', 5), ('Sat', 6), ('Sun', 7)) d(day, n)),
a AS (SELECT account_id FROM hh WHERE {WINDOW} UNION {ACCOUNTS}), g AS (SELECT * FROM hh WHERE {WINDOW} AND {GROSS}),
p AS (SELECT a.account_id, day, n, count(g.id) AS txns, CAST(COALESCE(sum(-amount_cents), 0) AS BIGINT) AS spend_cents
 FROM a CROSS JOIN days LEFT JOIN g ON g.account_id = a.account_id AND isodow(booking_date) = n GROUP BY ALL)
SELECT account_id, day, txns, spend_cents, n >= 6 AS weekend,
 CAST(sum(CASE WHEN n < 6 THEN spend_cents ELSE 0 END) OVER (PARTITION BY account_id) AS BIGINT) AS weekday_cents,
 CAST(sum(CASE WHEN n >= 6 THEN spend_cents ELSE 0 END) OVER (PARTITION BY account_id) AS BIGINT) AS weekend_cents FROM p""",
    "daily_spend": f"WITH {HOUSEHOLD} SELECT account_id, booking_date, CAST(sum(-amount_cents) AS BIGINT) AS spend_cents FROM hh WHERE {GROSS} AND {LONG} GROUP BY ALL",
    "burn_rate": f"""WITH {HOUSEHOLD},
d AS (SELECT account_id, booking_date, CAST(date_trunc('month', booking_date) AS DATE) AS m, sum(-amount_cents) AS s FROM hh WHERE {GROSS} AND {WINDOW} GROUP BY ALL),
months AS (SELECT account_id, m, max(booking_date) AS last FROM d GROUP BY account_id, m QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY m DESC) <= 4),
line AS (SELECT account_id, greatest(30, max(day(last_day(m)))) AS n FROM months GROUP BY ALL),
days AS (SELECT account_id, m, CAST(unnest(generate_series(m, last, INTERVAL 1 DAY)) AS DATE) AS booking_date FROM months)
SELECT days.account_id, strftime(days.m, '%Y-%m') AS month, CAST(day(days.booking_date) AS INTEGER) AS day,
 CAST(sum(COALESCE(s, 0)) OVER (PARTITION BY days.account_id, days.m ORDER BY days.booking_date) AS BIGINT) AS cumulative_cents,
 round(10000000.0::DOUBLE * (day(days.booking_date) - 1) / (n - 1), 6) AS even_spend_cents
FROM days JOIN line ON line.account_id = days.account_id LEFT JOIN d ON d.account_id = days.account_id AND d.booking_date = days.booking_date""",
    "spend_totals": f"""WITH {HOUSEHOLD}, g AS (SELECT * FROM hh WHERE {GROSS} AND {WINDOW})
SELECT a.account_id, count(g.id) AS txns, CAST(COALESCE(sum(-amount_cents), 0) AS BIGINT) AS spend_cents
FROM ({ACCOUNTS} UNION SELECT account_id FROM g) a LEFT JOIN g ON g.account_id = a.account_id GROUP BY a.account_id""",
    "bucket_spend": f"""WITH {HOUSEHOLD} SELECT account_id, bucket, cents AS net_cents FROM {bucket_table("hh", WINDOW, 3_000_000, f"SELECT account_id FROM hh WHERE {WINDOW} UNION {ACCOUNTS}")} x""",
    "held_inflows": f"""WITH {HOUSEHOLD} SELECT account_id, count(*) FILTER (amount_cents >= 3000000 AND category = 'Uncategorized') AS inflow_count,
 CAST(COALESCE(sum(amount_cents) FILTER (amount_cents >= 3000000 AND category = 'Uncategorized'), 0) AS BIGINT) AS inflow_cents FROM hh WHERE {LONG} GROUP BY ALL""",
    "month_over_month": f"""WITH {HOUSEHOLD},
x AS (SELECT c.account_id, c.bucket, p.cents AS prev_cents, c.cents AS curr_cents
 FROM {bucket_table("hh", "booking_date BETWEEN DATE '2001-05-01' AND DATE '2001-05-31'", 3_000_000)} c
 JOIN {bucket_table("hh", "booking_date BETWEEN DATE '2001-04-01' AND DATE '2001-04-30'", 3_000_000)} p ON c.account_id = p.account_id AND c.bucket = p.bucket)
SELECT account_id, bucket, prev_cents, curr_cents, '2001-04' AS prev_month, '2001-05' AS curr_month, curr_cents - prev_cents AS delta_cents,
 CASE WHEN prev_cents = 0 THEN 100 ELSE CAST(round_even((curr_cents - prev_cents) * 100 / prev_cents::DOUBLE, 0) AS BIGINT) END AS delta_pct
FROM x WHERE prev_cents <> 0 OR curr_cents <> 0""",
    "month_surplus": f"""WITH {HOUSEHOLD}, x AS (SELECT account_id, strftime(booking_date, '%Y-%m') AS month,
 CAST(COALESCE(sum(amount_cents) FILTER (amount_cents > 0 AND category = 'Income'), 0) AS BIGINT) AS income_cents,
 CAST(COALESCE(sum(-amount_cents) FILTER ({net(3_000_000)}), 0) AS BIGINT) AS spend_cents FROM hh GROUP BY ALL)
SELECT *, income_cents - spend_cents AS surplus_cents FROM x""",
    "surplus_target": f"""WITH {HOUSEHOLD}, m AS (SELECT * FROM hh WHERE booking_date BETWEEN DATE '2001-05-01' AND DATE '2001-05-31'),
x AS (SELECT a.account_id, '2001-05' AS month,
 CAST(COALESCE(sum(amount_cents) FILTER (amount_cents > 0 AND category = 'Income'), 0) AS BIGINT) AS income_cents,
 CAST(COALESCE(sum(-amount_cents) FILTER ({net(3_000_000)}), 0) AS BIGINT) AS spend_cents
 FROM ({ACCOUNTS} UNION SELECT account_id FROM m) a LEFT JOIN m ON m.account_id = a.account_id GROUP BY a.account_id)
SELECT *, income_cents - spend_cents AS surplus_cents, CAST(100000 AS BIGINT) AS target_cents, income_cents - spend_cents >= 100000 AS met FROM x""",
    "bucket_breakdown": f"""WITH {HOUSEHOLD} SELECT account_id, category, CAST(sum(-amount_cents) AS BIGINT) AS gross_cents FROM hh
WHERE amount_cents < 0 AND ({BUCKET}) = 'Other' AND booking_date BETWEEN DATE '2001-06-01' AND DATE '2001-06-30' GROUP BY ALL""",
    "weekly_digest": f"WITH {DIGEST} SELECT * FROM dg",
    "top_movers": f"""WITH {DIGEST} SELECT account_id, bucket, delta_cents, CAST(row_number() OVER w AS INTEGER) AS rank FROM dg WHERE delta_cents <> 0
WINDOW w AS (PARTITION BY account_id ORDER BY abs(delta_cents) DESC, bucket) QUALIFY row_number() OVER w <= 3""",
    "top_spends": f"""WITH {EVENT} SELECT account_id, id, booking_date, merchant_raw, category, -amount_cents AS spend_cents, CAST(row_number() OVER w AS INTEGER) AS rank
FROM ev WHERE {GROSS} AND booking_date BETWEEN DATE '2024-01-19' AND DATE '2024-01-25'
WINDOW w AS (PARTITION BY account_id ORDER BY -amount_cents DESC, booking_date, id) QUALIFY row_number() OVER w <= 3""",
    "latest_in_category": f"""WITH {EVENT} SELECT account_id, id, booking_date, merchant_raw, -amount_cents AS spend_cents, CAST(row_number() OVER w AS INTEGER) AS rank,
 CAST(sum(-amount_cents) OVER (PARTITION BY account_id) AS BIGINT) AS month_total_cents
FROM ev WHERE amount_cents < 0 AND category = 'Groceries' AND {EVENTS}
WINDOW w AS (PARTITION BY account_id ORDER BY booking_date DESC, id) QUALIFY row_number() OVER w <= 4""",
    # ── reconciliation ──
    "reconciliation": f"WITH {HOUSEHOLD}, {reconciliation('account_id', LONG)} SELECT * FROM rc",
    "reconciliation_whole": f"""WITH {HOUSEHOLD}, {reconciliation('', "booking_date BETWEEN DATE '1995-01-01' AND DATE '2001-06-30'")} SELECT * FROM rc""",
    "gate_verdict": f"""WITH {HOUSEHOLD}, {reconciliation('account_id', LONG)} SELECT account_id, count(*) FILTER (full_month) AS full_months,
 max(abs(residual_cents)) FILTER (full_month) AS worst_cents, CASE WHEN count(*) FILTER (full_month) = 0 THEN 'PENDING'
 WHEN bool_and(gate_pass) FILTER (full_month) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM rc GROUP BY account_id""",
    "budget_baseline": f"""WITH {HOUSEHOLD}, {reconciliation('account_id', LONG)},
x AS (SELECT account_id, count(*) FILTER (full_month) AS n, CAST(sum(fixed_cents + variable_cents + uncategorized_cents) FILTER (full_month) AS BIGINT) AS s FROM rc GROUP BY ALL)
SELECT account_id, CASE WHEN n > 0 THEN s // n ELSE 0 END AS budget_cents,
 CASE WHEN n > 0 THEN 'full_month_average' ELSE 'no_full_month' END AS budget_source FROM x""",
    # ── pay cycle ──
    "payday_months": f"WITH {overrides(31)} SELECT account_id, cycle_month, actual_date FROM ov",
    "payday_calendar": f"WITH {calendar('2001-01-01', '2001-08-01', 31)} SELECT account_id, cycle_month, payday, payday_source FROM cal",
    "pay_cycles": f"WITH {calendar('2001-01-01', '2001-08-01', 31)} SELECT * FROM cyc",
    "cycle_spend": f"""WITH {HOUSEHOLD}, {calendar('2000-01-01', '2001-08-01', 23)}
SELECT c.account_id, cycle_start, next_payday, cycle_source, CAST(sum(-amount_cents) AS BIGINT) AS net_discretionary_cents
FROM hh JOIN cyc c ON c.account_id = hh.account_id AND booking_date >= cycle_start AND booking_date < next_payday
WHERE {net(3_000_000)} AND ({BUCKET}) IN ('Groceries', 'FoodDelivery', 'Other') GROUP BY ALL""",
    "safe_to_spend": f"""WITH {HOUSEHOLD}, {calendar('2001-04-01', '2001-08-01', 23)},
now AS (SELECT cyc.*, h.amount_cents, h.category FROM cyc LEFT JOIN hh h ON h.account_id = cyc.account_id
 AND h.booking_date BETWEEN cycle_start AND DATE '2001-06-30'
 WHERE cycle_start <= DATE '2001-06-30' AND next_payday > DATE '2001-06-30'),
{status("account_id, ", 9_000_000, "now")}
SELECT account_id, cycle_start, cycle_source, next_payday, days_left, pool_cents, discretionary_cents, remaining_cents, safe_today_cents FROM status""",
    "account_status": f"""WITH {HOUSEHOLD}, {STATEMENT},
now AS (SELECT CAST(c_custkey AS VARCHAR) AS account_id, DATE '2001-06-23' AS cycle_start, 'scheduled' AS cycle_source, DATE '2001-07-23' AS next_payday,
 h.amount_cents, h.category FROM customer LEFT JOIN hh h ON h.account_id = CAST(c_custkey AS VARCHAR) AND h.booking_date BETWEEN DATE '2001-06-23' AND DATE '2001-06-30'),
{status("account_id, ", 9_000_000, "now")},
held AS (SELECT CASE WHEN account = '' THEN '' ELSE account[5:5] END AS account_id, count(*) AS n FROM
 (SELECT DISTINCT account, credit, date, debit FROM verdict WHERE v LIKE 'reject%') GROUP BY ALL)
SELECT status.*, COALESCE(n, 0) AS quarantined FROM status LEFT JOIN held ON held.account_id = status.account_id""",
    "account_status_whole": f"""WITH {HOUSEHOLD},
now AS (SELECT DATE '2001-06-23' AS cycle_start, 'scheduled' AS cycle_source, DATE '2001-07-23' AS next_payday, amount_cents, category
 FROM hh WHERE booking_date BETWEEN DATE '2001-06-23' AND DATE '2001-06-30'),
{status("", 3_600_000_000, "now")} SELECT *, CAST(0 AS BIGINT) AS quarantined FROM status""",
    "weekly_plan": f"""WITH {HOUSEHOLD},
now AS (SELECT a.account_id, DATE '2001-06-23' AS cycle_start, 'scheduled' AS cycle_source, DATE '2001-07-23' AS next_payday, amount_cents, category
 FROM ({ACCOUNTS}) a
 LEFT JOIN hh h ON h.account_id = a.account_id AND h.booking_date BETWEEN DATE '2001-06-23' AND DATE '2001-06-30'),
{status("account_id, ", 9_000_000, "now")}
SELECT account_id, days_left, CAST(4 AS BIGINT) AS weeks_left, remaining_cents, greatest(0, remaining_cents // 4) AS week_budget_cents,
 CAST(2076923 AS BIGINT) AS weekly_rail_cents, light FROM status""",
    # ── caps, bills, recurring ──
    "policy_matches": f"""WITH {EVENT}, pol AS (SELECT * FROM (VALUES (0, 'view-cap', 1500), (1, 'shop-cap', 4000), (2, 'misc-cap', 3000)) p(ord, policy, cap_cents)),
h AS (SELECT batch_ord, ord, policy, CAST(cap_cents AS BIGINT) AS cap_cents FROM ev JOIN pol ON (ord = 0 AND category = 'FoodDelivery')
 OR (ord = 1 AND merchant_key IN ('VIEW HOUSE', 'PURCHASE HOUSE')) OR (ord = 2 AND ({BUCKET}) = 'Other'))
SELECT *, ord = min(ord) OVER (PARTITION BY batch_ord) AS is_first FROM h""",
    "policy_progress_hot": f"""WITH {POLICIES.replace("pol AS (", "ev2 AS (SELECT * REPLACE (CASE WHEN batch_ord % 3 <> 0 THEN account_id END AS account_id), batch_ord % 2 = 0 AS batched FROM ev), pol AS (", 1).replace("FROM ev ", "FROM ev2 ", 1).replace("month FROM ev", "month FROM ev2", 1)},
{progress().replace("ORDER BY booking_date, batch_ord", "ORDER BY booking_date, batched, batch_ord")}
SELECT batch_ord, account_id, ord, mtd_cents, charge_number FROM prog""",
    "bucketed_progress": f"WITH {POLICIES}, {progress()} SELECT batch_ord, account_id, ord, mtd_cents, charge_number FROM prog",
    "policy_progress": f"WITH {POLICIES}, {progress()} SELECT batch_ord, account_id, ord, mtd_cents, charge_number FROM prog",
    "policy_alerts": f"""WITH {POLICIES}, {progress()} SELECT id, account_id, booking_date, strftime(month, '%Y-%m') AS month, policy, CAST(cap_cents AS BIGINT) AS cap_cents,
 amount_cents, mtd_cents, charge_number, merchant_raw || ': ' || {EUR.format("(-amount_cents)")} || ', ' || {ORDINAL.format("charge_number")} || ' charge this month. '
 || policy || ' stands at ' || {EUR.format("mtd_cents")} || ' against a cap of ' || {EUR.format("cap_cents")} || '; that is ' || {EUR.format("(mtd_cents * 12)")} || ' a year.' AS text FROM al""",
    "kept_alerts": f"""WITH {POLICIES}, {progress().replace("ORDER BY booking_date, batch_ord", "ORDER BY booking_date, batch_ord % 4 = 0, batch_ord")}
SELECT id, account_id, booking_date, strftime(month, '%Y-%m') AS month, policy, CAST(cap_cents AS BIGINT) AS cap_cents,
 amount_cents, mtd_cents, charge_number, merchant_raw || ': ' || {EUR.format("(-amount_cents)")} || ', ' || {ORDINAL.format("charge_number")} || ' charge this month. '
 || policy || ' stands at ' || {EUR.format("mtd_cents")} || ' against a cap of ' || {EUR.format("cap_cents")} || '; that is ' || {EUR.format("(mtd_cents * 12)")} || ' a year.' AS text
FROM al WHERE batch_ord % 4 = 0""",
    "kept_sums": f"""WITH {POLICIES} SELECT account_id, CAST(ord AS INTEGER) AS ord, booking_date, CASE WHEN batch_ord % 4 = 0 THEN 'load-2' ELSE 'load-1' END AS batch_id,
 CAST(sum(-amount_cents) AS BIGINT) AS cents, count(*) FILTER (amount_cents < 0) AS charges FROM hits GROUP BY ALL""",
    "policy_alerts_whole": f"""WITH {POLICIES}, {progress("")} SELECT id, booking_date, strftime(month, '%Y-%m') AS month, policy, CAST(cap_cents AS BIGINT) AS cap_cents,
 amount_cents, mtd_cents, charge_number FROM al""",
    "alerts_unsent": f"""WITH {POLICIES}, {progress()} SELECT 'policy_alert' AS kind, id AS subject_id, account_id, policy, mtd_cents FROM al
WHERE booking_date >= DATE '2024-01-20' AND merchant_key <> 'PURCHASE HOUSE'""",
    "rows_since_mark": f"WITH {EVENT} SELECT batch_ord, account_id, amount_cents FROM ev WHERE booking_date > DATE '2024-01-20'",
    "current_dues": """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(o_orderkey % 31 AS INTEGER) AS k FROM orders),
t AS (SELECT *, least(CAST(m + k AS DATE), last_day(m)) AS this_month, CAST(m - INTERVAL 1 MONTH AS DATE) AS pm FROM o)
SELECT o_orderkey, CASE WHEN this_month <= d THEN this_month ELSE least(CAST(pm + k AS DATE), last_day(pm)) END AS due, this_month, strftime(d, '%G-W%V') AS iso_week FROM t""",
    "own_policy_matches": f"""WITH {OWN_POLICIES.format(threshold=10 ** 12)}
SELECT batch_ord, CAST(ord AS BIGINT) AS ord, policy, CAST(cap_cents AS BIGINT) AS cap_cents, ord = min(ord) OVER (PARTITION BY id) AS is_first FROM hits""",
    "own_policy_alerts": f"""WITH {OWN_POLICIES.format(threshold=1000)}, {progress()} SELECT id, account_id, booking_date, strftime(month, '%Y-%m') AS month, policy,
 CAST(cap_cents AS BIGINT) AS cap_cents,
 amount_cents, mtd_cents, charge_number, merchant_raw || ': ' || {EUR.format("(-amount_cents)")} || ', ' || {ORDINAL.format("charge_number")} || ' charge this month. '
 || policy || ' stands at ' || {EUR.format("mtd_cents")} || ' against a cap of ' || {EUR.format("cap_cents")} || '; that is ' || {EUR.format("(mtd_cents * 12)")} || ' a year.' AS text FROM al""",
    "own_bill_states": f"WITH {OWN_BILLS} SELECT * FROM state",
    "own_bill_alerts": f"""WITH {OWN_BILLS},
x AS (SELECT *, CASE WHEN paid_on IS NOT NULL AND NOT paid_cents BETWEEN low_cents AND high_cents THEN 'drift' WHEN overdue THEN 'late' END AS kind FROM state)
SELECT account_id, as_of, bill, kind, due, paid_on, paid_cents, expected_cents, CAST(days_past_due AS INTEGER) AS days_past_due,
 CASE kind WHEN 'drift' THEN bill || ' came to ' || {EUR.format("paid_cents")} || ' instead of about ' || {EUR.format("expected_cents")}
  ELSE bill || ' has not been paid, ' || days_past_due || ' days after ' || due END AS text, bill || '|' || due || '|' || kind AS period_key
FROM x WHERE kind IS NOT NULL""",
    "bill_matches": f"WITH {BILLS} SELECT * FROM paid",
    "bill_alerts": f"""WITH {BILLS},
x AS (SELECT *, CASE WHEN paid_on IS NOT NULL AND NOT paid_cents BETWEEN low_cents AND high_cents THEN 'drift' WHEN overdue THEN 'late' END AS kind FROM state)
SELECT account_id, bill, kind, due, paid_on, paid_cents, CAST(expected_cents AS BIGINT) AS expected_cents, CAST(days_past_due AS INTEGER) AS days_past_due,
 CASE kind WHEN 'drift' THEN bill || ' came to ' || {EUR.format("paid_cents")} || ' instead of about ' || {EUR.format("expected_cents")}
  ELSE bill || ' has not been paid, ' || days_past_due || ' days after ' || due END AS text, bill || '|' || due || '|' || kind AS period_key
FROM x WHERE kind IS NOT NULL""",
    "bill_alerts_unsent": f"""WITH {BILLS},
x AS (SELECT *, CASE WHEN paid_on IS NOT NULL AND NOT paid_cents BETWEEN low_cents AND high_cents THEN 'drift' WHEN overdue THEN 'late' END AS kind FROM state)
SELECT account_id, bill, kind, due, bill || '|' || due || '|' || kind AS period_key FROM x WHERE kind = 'drift' AND CAST(account_id AS BIGINT) % 2 = 0""",
    "bill_checklist": f"""WITH {BILLS} SELECT account_id, bill, due, CASE WHEN paid_on IS NOT NULL THEN 'paid' WHEN overdue THEN 'overdue' ELSE 'pending' END AS status,
 paid_on, paid_cents FROM state""",
    "charge_gaps": f"WITH {RECURRING} SELECT account_id, merchant_key, CAST(gap AS INTEGER) AS gap_days, count(*) AS times FROM ch WHERE gap IS NOT NULL GROUP BY ALL",
    "bucketed_recurring": f"WITH {RECURRING} SELECT * FROM rec",
    "recurring_kept": f"WITH {RECURRING} SELECT * FROM rec",
    "charge_maps": f"""WITH {EVENT} SELECT account_id, merchant_key, CAST(date_trunc('month', booking_date) AS DATE) AS month,
 CAST(coalesce(bit_or(CASE WHEN amount_cents < 0 THEN 1::INTEGER << (day(booking_date) - 1)::INTEGER END), 0) AS INTEGER) AS days, count(*) FILTER (amount_cents < 0) AS charges,
 CAST(coalesce(sum(-amount_cents) FILTER (amount_cents < 0), 0) AS BIGINT) AS cents,
 CAST(coalesce(sum(amount_cents * amount_cents) FILTER (amount_cents < 0), 0) AS BIGINT) AS squares, min(booking_date) AS first_seen FROM ev GROUP BY ALL""",
    "recurring_charges": f"WITH {RECURRING} SELECT * FROM rec",
    "recurring_totals": f"WITH {RECURRING} SELECT account_id, count(*) AS merchants, CAST(sum(annualized_cents) AS BIGINT) AS annualized_cents FROM rec GROUP BY ALL",
    # ── stream transformations on tables ──
    "daily_windows": f"WITH {EVENT} SELECT account_id, booking_date AS day, CAST(sum(-amount_cents) AS BIGINT) AS spend_cents, count(*) AS txns FROM ev WHERE {GROSS} GROUP BY ALL",
    "weekly_windows": f"""WITH {EVENT}, x AS (SELECT account_id, amount_cents, CAST(booking_date + CAST(unnest(range(0, 7)) AS INTEGER) AS DATE) AS day FROM ev WHERE {GROSS})
SELECT account_id, day, CAST(sum(-amount_cents) AS BIGINT) AS spend_cents, count(*) AS txns FROM x GROUP BY ALL""",
    "deduped_events": f"WITH {EVENT} SELECT id, account_id, amount_cents FROM ev",
    "emitted_once": f"""WITH {EVENT} SELECT DISTINCT account_id, booking_date AS as_of, 'weekly_plan' AS kind, strftime(booking_date, '%G-W%V') AS period_key FROM ev
WHERE (account_id, strftime(booking_date, '%G-W%V')) NOT IN (SELECT (account_id, strftime(booking_date, '%G-W%V')) FROM ev WHERE category = 'Groceries')""",
    # ── text scans ──
    "secret_shapes": r"""WITH s AS (SELECT * FROM (VALUES ('api_key', '(?i)sk-[A-Za-z0-9_-]{20}'), ('private_key', '(?i)BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY'),
 ('chat_token', '(?i)xox[baprs]-[A-Za-z0-9-]{10}'), ('cloud_key', '(?i)AKIA[0-9A-Z]{16}')) v(shape, p)),
m AS (SELECT shape, len(regexp_extract_all(text, p)) AS n FROM documents, s)
SELECT shape, count(*) FILTER (n > 0) AS texts, CAST(sum(n) AS BIGINT) AS matches FROM m GROUP BY shape""",
    "secret_flags": r"""SELECT doc_id, regexp_matches(text, '(?i)sk-[A-Za-z0-9_-]{20}') AS has_api_key,
 regexp_matches(text, '(?i)BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY') AS has_private_key,
 regexp_matches(text, '(?i)xox[baprs]-[A-Za-z0-9-]{10}') AS has_chat_token, regexp_matches(text, '(?i)AKIA[0-9A-Z]{16}') AS has_cloud_key FROM documents""",
    "pattern_hits": r"SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '(?i)\bwhst\b|eaux+ le|[0-9]{3}-[0-9]{4}')",
    "redacted_texts": """SELECT doc_id, sha256(replace(replace(text, 'the', '***'), 'ou', '***')) AS digest,
 CAST(length(replace(replace(text, 'the', '***'), 'ou', '***')) AS INTEGER) AS chars FROM documents""",
}
