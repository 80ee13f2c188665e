"""DuckDB oracle SQL for the registered queries (same column names and
types as the Spark results).  Each statement repeats, in plain SQL, the
derivation of the messy inputs from the driver tables, then the operator
semantics.  Money is exact DECIMAL on both sides; sums are cast to the
Spark result widths; counts to BIGINT."""

from __future__ import annotations

# Spark date patterns of DEFAULT_TS_FORMATS in strftime form, same order.
TS_FORMATS_SQL = ["%Y/%m/%d %H:%M:%S", "%d-%b-%Y", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d",
                  "%Y/%m/%d", "%d/%m/%Y %H:%M:%S"]
_FMT_LIST = "[" + ", ".join(f"'{f}'" for f in TS_FORMATS_SQL) + "]"


def _render(ts: str, key: str) -> str:
    whens = " ".join(f"WHEN {i} THEN strftime({ts}, '{f}')" for i, f in enumerate(TS_FORMATS_SQL))
    return f"CASE {key} % 7 {whens} ELSE 'invalid_date_here' END"


COMPLETED_TX = """tx AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS transaction_timestamp,
         CAST(o_totalprice AS DECIMAL(18,2)) AS gross_amount,
         CAST((o_orderkey % 10) * 0.01 AS DECIMAL(5,4)) AS tax_rate,
         CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PENDING'
              WHEN 'P' THEN 'CANCELLED' ELSE 'UNKNOWN' END AS order_status
  FROM orders)"""

DAILY = COMPLETED_TX + """,
daily AS (
  SELECT CAST(transaction_timestamp AS DATE) AS transaction_date,
         CAST(count(DISTINCT order_id) AS BIGINT) AS order_count,
         CAST(sum(gross_amount) AS DECIMAL(28,2)) AS daily_gross_revenue,
         CAST(sum(gross_amount * tax_rate) AS DECIMAL(34,6)) AS daily_tax_collected
  FROM tx WHERE order_status = 'COMPLETED' AND transaction_timestamp IS NOT NULL
  GROUP BY 1)"""

LINE_ORDER_SQL = ("l_shipdate DESC NULLS LAST, l_partkey DESC NULLS LAST, l_suppkey DESC NULLS LAST, "
                  "l_quantity DESC NULLS LAST, l_extendedprice DESC NULLS LAST, "
                  "l_discount DESC NULLS LAST, l_tax DESC NULLS LAST, "
                  "l_returnflag DESC NULLS LAST, l_linestatus DESC NULLS LAST")

RAW_TX = f"""kinds AS (
  SELECT *, unnest(CASE o_orderkey % 20 WHEN 0 THEN [0, 1] WHEN 1 THEN [0, 2] WHEN 2 THEN [0, 3] ELSE [0] END) AS kind
  FROM orders),
o AS (
  SELECT * REPLACE (o_orderdate + CASE kind WHEN 2 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS o_orderdate,
                    CAST(o_totalprice AS DECIMAL(18,2)) + CASE kind WHEN 2 THEN 5 WHEN 3 THEN 1 ELSE 0 END AS o_totalprice)
  FROM kinds),
raw AS (
  SELECT CASE WHEN o_orderkey % 58 = 0 THEN ' null' WHEN o_orderkey % 29 = 0 THEN NULL
              ELSE 'O-' || o_orderkey END AS order_id,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL
              WHEN o_orderkey % 5 = 0 THEN '  C_' || o_custkey || ' '
              ELSE 'C_' || o_custkey END AS cust_id,
         {_render('o_orderdate', 'o_orderkey')} AS txn_dt,
         CASE WHEN o_orderkey % 4 = 0 THEN 'NULL' WHEN o_orderkey % 4 = 1 THEN ''
              ELSE '[' || (o_custkey % 300) || ':1:' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || ']'
         END AS item_details,
         CASE WHEN o_orderkey % 17 = 0 THEN 'FREE'
              ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS gross_amt,
         CAST(CAST((o_orderkey % 10) * 0.01 AS DECIMAL(3,2)) AS VARCHAR) AS tax_rate,
         CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 3 = 0 THEN ' completed' ELSE 'COMPLETED' END
              WHEN o_orderstatus = 'O' THEN 'PENDING' ELSE 'cancelled' END AS status,
         CASE o_orderkey % 5 WHEN 0 THEN 'cc' WHEN 1 THEN 'paypal' WHEN 2 THEN 'giftcard'
              WHEN 3 THEN 'CreditCard' END AS p_method,
         'part-' || (o_orderkey // 5000) AS _source_file
  FROM o)"""


def _null_tok(c: str) -> str:
    return f"CASE WHEN upper(trim({c})) IN ('NULL', '') THEN NULL ELSE {c} END"


RAW_ITEMS = """raw AS (
  SELECT l_orderkey, l_linenumber,
    CASE WHEN l_orderkey % 19 = 0 THEN 'NULL'
         WHEN l_orderkey % 23 = 0 THEN '[]'
         ELSE '[' || l_partkey || ':1:' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)
              || CASE WHEN l_linenumber % 2 = 0
                      THEN '|' || l_suppkey || ':' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ':'
                           || CAST(CAST(l_tax AS DECIMAL(4,2)) AS VARCHAR)
                      ELSE '' END
              || CASE WHEN l_linenumber % 5 = 0 THEN '|x:1:bad' ELSE '' END || ']'
    END AS item_details,
    CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2))
              + CASE WHEN l_linenumber % 2 = 0
                     THEN CAST(CAST(l_quantity AS INTEGER) AS DECIMAL(10,0)) * CAST(l_tax AS DECIMAL(4,2))
                     ELSE CAST(0 AS DECIMAL(4,2)) END
              + CASE WHEN l_orderkey % 10 = 0 THEN CAST(0.01 AS DECIMAL(3,2)) ELSE 0 END
         AS DECIMAL(18,2)) AS VARCHAR) AS header_amount
  FROM lineitem),
p AS (
  SELECT l_orderkey, l_linenumber, header_amount,
    CASE WHEN regexp_matches(trim(item_details), '^\\[(.*)\\]$')
          AND trim(regexp_extract(trim(item_details), '^\\[(.*)\\]$', 1)) <> ''
         THEN string_split(regexp_extract(trim(item_details), '^\\[(.*)\\]$', 1), '|') END AS parts
  FROM raw)"""

RAW_ACCOUNTS = """j AS (
  SELECT o.o_orderkey, o.o_orderdate, o.o_totalprice, o.o_orderstatus, c.c_custkey, c.c_name, c.c_mktsegment
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
raw AS (
  SELECT rpad('C' || c_custkey, 10, ' ') AS CUST_ID,
         rpad(c_mktsegment, 25, ' ') AS FIRST_NAME,
         CASE WHEN o_orderkey % 2 = 0 THEN 'X' END AS MID_INIT,
         rpad(c_name, 30, ' ') AS LAST_NAME,
         CASE WHEN o_orderkey % 31 = 0 THEN strftime(o_orderdate, '%Y') || '13' || strftime(o_orderdate, '%d')
              ELSE strftime(o_orderdate, '%Y%m%d') END AS OPEN_DT,
         CASE o_orderkey % 4 WHEN 0 THEN 'SV ' WHEN 1 THEN 'CH' WHEN 2 THEN ' CD' ELSE 'XX' END AS ACCT_TYPE,
         CAST(o_totalprice AS DECIMAL(15,2)) AS CURR_BAL,
         CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(500 + (c_custkey * 37) % 350 AS INTEGER) END AS CR_SCORE,
         CASE WHEN o_orderkey % 29 = 0 THEN 'Z' WHEN o_orderstatus = 'O' THEN 'A'
              WHEN o_orderstatus = 'F' THEN 'I' ELSE 'D' END AS STATUS_CD
  FROM j),
silver AS (
  SELECT trim(CUST_ID) AS customer_id, trim(FIRST_NAME) AS first_name, trim(LAST_NAME) AS last_name,
         CASE trim(ACCT_TYPE) WHEN 'SV' THEN 'Savings' WHEN 'CH' THEN 'Checking'
              WHEN 'CD' THEN 'Certificate of Deposit' ELSE 'Unknown' END AS account_type,
         TRY_CAST(trim(CAST(CURR_BAL AS VARCHAR)) AS DECIMAL(15,2)) AS current_balance,
         TRY_CAST(trim(CAST(CR_SCORE AS VARCHAR)) AS INTEGER) AS credit_score,
         CASE trim(STATUS_CD) WHEN 'A' THEN 'Active' WHEN 'I' THEN 'Inactive'
              WHEN 'D' THEN 'Dormant' ELSE 'Other' END AS account_status
  FROM raw)"""

TIER = """CASE WHEN {v} >= 100000 OR credit_score >= 750 THEN 'Tier 1 (Platinum)'
            WHEN {v} >= 25000 AND credit_score >= 650 THEN 'Tier 2 (Gold)'
            ELSE 'Tier 3 (Standard)' END"""

FAULTY = """f AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_orderkey END AS order_id,
         CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE o_custkey END AS customer_id,
         CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE o_orderdate END AS order_ts,
         CASE WHEN o_orderkey % 41 = 0 THEN -CAST(o_totalprice AS DECIMAL(18,2))
              ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS amount,
         CASE WHEN o_orderkey % 47 = 0 THEN 'LOST' ELSE o_orderstatus END AS order_status,
         o_orderkey // 2 AS pair_id
  FROM orders)"""


def _extract(col: str, lang: str | None) -> str:
    lang_pat = r"(?is)`{3,}" + lang + r"\b[^\n]*\n(.*?)\n`{3,}" if lang else None
    any_pat = r"(?s)`{3,}[^\n]*\n(.*?)\n`{3,}"

    def strip(x):
        return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    parts = []
    if lang_pat:
        parts.append(f"WHEN regexp_matches({col}, '{lang_pat}') "
                     f"THEN {strip(f'regexp_extract({col}, {chr(39)}{lang_pat}{chr(39)}, 1)')}")
    parts.append(f"WHEN regexp_matches({col}, '{any_pat}') "
                 f"THEN {strip(f'regexp_extract({col}, {chr(39)}{any_pat}{chr(39)}, 1)')}")
    return "CASE " + " ".join(parts) + f" ELSE {strip(col)} END"


_NL = "chr(10)"

FENCED = f"""t AS (
  SELECT conv_id, turn,
    CASE (conv_id * 7 + turn) % 5
      WHEN 0 THEN '````SQL filename=models/gold/m.sql' || {_NL} || text || {_NL} || '````' || {_NL}
                  || 'then' || {_NL} || '```yaml' || {_NL} || role || ': ' || turn || {_NL} || '```'
      WHEN 1 THEN '```sql' || {_NL} || text || {_NL} || '```' || {_NL} || '```yml' || {_NL}
                  || 'k: ' || turn || {_NL} || '```'
      WHEN 2 THEN {_NL} || text || {_NL}
      WHEN 3 THEN 'intro' || {_NL} || '```python' || {_NL} || '  ' || text || '  ' || {_NL} || '```' || {_NL}
      ELSE text END AS reply
  FROM conversations)"""


def _json_text(v: str, t: str) -> str:
    """Text of a json_each value as Spark's map<string,string> holds it."""
    return f"CASE WHEN {t} = 'VARCHAR' THEN {v} ->> '$' ELSE CAST({v} AS VARCHAR) END"


RAW_JSON = """raw AS (
  SELECT event_id,
    CASE WHEN event_id % 97 = 0 THEN '{oops' || event_id
         WHEN event_id % 7 = 0 THEN '{"k": "bad' || event_id || '"}'
         WHEN event_id % 5 = 0 THEN '{"k": ' || user_id || ', "extra": {"z": ' || event_id || '}}'
         WHEN event_id % 3 = 0 THEN '{"k": ' || user_id || ', "src": "' || event_type || '"}'
         ELSE props END AS value
  FROM events)"""


SQL: dict[str, str] = {}

SQL["daily_revenue"] = f"""WITH {DAILY}
SELECT transaction_date, order_count, daily_gross_revenue, daily_tax_collected,
       avg(order_count) OVER (ORDER BY transaction_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
         AS rolling_7d_avg_orders
FROM daily"""

SQL["daily_revenue_calendar"] = f"""WITH {DAILY}
SELECT transaction_date, order_count, daily_gross_revenue, daily_tax_collected,
       avg(order_count) OVER (ORDER BY transaction_date
                              RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)
         AS rolling_7d_avg_orders
FROM daily"""

SQL["revenue_by_category_daily"] = """WITH items AS (
  SELECT l.l_orderkey AS order_id, l.l_partkey AS item_id, CAST(o.o_orderdate AS DATE) AS transaction_date,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) * (CAST(1 AS DECIMAL(3,2)) - CAST(l.l_discount AS DECIMAL(4,2)))
           AS line_revenue,
         CAST(l.l_tax AS DECIMAL(4,2)) AS tr
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  WHERE o.o_orderstatus = 'F'),
cat AS (
  SELECT i.*, i.line_revenue * i.tr AS line_tax, COALESCE(p.p_type, 'Unknown') AS category
  FROM items i LEFT JOIN part p ON i.item_id = p.p_partkey),
daily AS (
  SELECT transaction_date, category,
         CAST(count(DISTINCT order_id) AS BIGINT) AS order_count,
         CAST(sum(line_revenue) AS DECIMAL(38,4)) AS daily_gross_revenue,
         CAST(sum(line_tax) AS DECIMAL(38,6)) AS daily_tax_collected
  FROM cat WHERE transaction_date IS NOT NULL GROUP BY 1, 2)
SELECT *, avg(order_count) OVER (PARTITION BY category ORDER BY transaction_date
                                 ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling_7d_avg_orders
FROM daily"""

SQL["keep_latest_lineitem"] = f"""SELECT * FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_ORDER_SQL}) = 1"""

SQL["keep_latest_event_per_user"] = """SELECT * FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) = 1"""

SQL["parse_dates"] = f"""WITH r AS (
  SELECT o_orderkey, {_render('o_orderdate', 'o_orderkey')} AS raw_date FROM orders)
SELECT o_orderkey, raw_date, try_strptime(trim(raw_date), {_FMT_LIST}) AS parsed_ts FROM r"""

SQL["char_dates"] = """WITH r AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 11 = 0 THEN strftime(o_orderdate, '%Y') || '13' || strftime(o_orderdate, '%d')
              ELSE strftime(o_orderdate, '%Y%m%d') END AS open_dt
  FROM orders)
SELECT o_orderkey, open_dt, CAST(try_strptime(trim(open_dt), '%Y%m%d') AS DATE) AS open_date FROM r"""

CONFORMED = f"""{RAW_TX},
n AS (
  SELECT {_null_tok('order_id')} AS order_id, {_null_tok('cust_id')} AS cust_id, txn_dt,
         {_null_tok('item_details')} AS item_details,
         gross_amt, tax_rate, {_null_tok('status')} AS status, {_null_tok('p_method')} AS p_method, _source_file
  FROM raw),
typed AS (
  SELECT *, try_strptime(trim(txn_dt), {_FMT_LIST}) AS ts,
         TRY_CAST(trim(gross_amt) AS DECIMAL(18,2)) AS gross,
         TRY_CAST(trim(tax_rate) AS DECIMAL(5,4)) AS rate
  FROM n),
tagged AS (
SELECT sha256(concat_ws('||', order_id, cust_id)) AS sk_transaction,
       order_id, cust_id AS customer_id, ts AS transaction_timestamp,
       item_details AS raw_item_details,
       COALESCE(gross, CAST(0 AS DECIMAL(18,2))) AS gross_amount,
       COALESCE(rate, CAST(0 AS DECIMAL(5,4))) AS tax_rate,
       COALESCE(upper(trim(status)), 'UNKNOWN') AS order_status,
       p_method AS payment_method_raw,
       CASE p_method WHEN 'cc' THEN 'Credit Card' WHEN 'paypal' THEN 'PayPal'
            WHEN 'giftcard' THEN 'Gift Card' ELSE 'Other' END AS payment_method,
       CASE WHEN (txn_dt IS NOT NULL AND ts IS NULL) OR (gross_amt IS NOT NULL AND gross IS NULL)
                 OR (tax_rate IS NOT NULL AND rate IS NULL)
            THEN CAST(to_json(map_from_entries(list_filter([
                   {{'k': 'txn_dt', 'v': CASE WHEN txn_dt IS NOT NULL AND ts IS NULL THEN txn_dt END}},
                   {{'k': 'gross_amt', 'v': CASE WHEN gross_amt IS NOT NULL AND gross IS NULL THEN gross_amt END}},
                   {{'k': 'tax_rate', 'v': CASE WHEN tax_rate IS NOT NULL AND rate IS NULL THEN tax_rate END}}
                 ], lambda x: x.v IS NOT NULL))) AS VARCHAR)
       END AS _rescued_data,
       _source_file,
       concat_ws(';', CASE WHEN order_id IS NULL THEN 'missing:order_id' END,
                      CASE WHEN ts IS NULL THEN 'missing:transaction_timestamp' END) AS _reject_reason
FROM typed),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY transaction_timestamp DESC NULLS LAST,
    _reject_reason DESC NULLS LAST, _rescued_data DESC NULLS LAST, _source_file DESC NULLS LAST,
    customer_id DESC NULLS LAST, gross_amount DESC NULLS LAST, order_status DESC NULLS LAST,
    payment_method DESC NULLS LAST, payment_method_raw DESC NULLS LAST, raw_item_details DESC NULLS LAST,
    sk_transaction DESC NULLS LAST, tax_rate DESC NULLS LAST) AS place
  FROM tagged),
silver AS (SELECT * EXCLUDE (place) FROM ranked WHERE order_id IS NOT NULL AND place = 1),
valid AS (SELECT * FROM silver WHERE _reject_reason = ''),
quarantine AS (SELECT * FROM silver WHERE _reject_reason <> ''
               UNION ALL SELECT * FROM tagged WHERE order_id IS NULL)"""

SQL["conform_orders"] = f"""WITH {CONFORMED}
SELECT * EXCLUDE (_reject_reason) FROM silver"""

SQL["transactions_gold_daily"] = f"""WITH {CONFORMED},
daily AS (
  SELECT CAST(transaction_timestamp AS DATE) AS transaction_date,
         CAST(count(DISTINCT order_id) AS BIGINT) AS order_count,
         CAST(sum(gross_amount) AS DECIMAL(28,2)) AS daily_gross_revenue,
         CAST(sum(gross_amount * tax_rate) AS DECIMAL(34,6)) AS daily_tax_collected
  FROM valid WHERE order_status = 'COMPLETED' GROUP BY 1)
SELECT *, avg(order_count) OVER (ORDER BY transaction_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
            AS rolling_7d_avg_orders
FROM daily"""

SQL["transactions_quarantine"] = f"""WITH {CONFORMED}
SELECT order_id, customer_id, raw_item_details, gross_amount, order_status, _rescued_data, _reject_reason
FROM quarantine"""

SQL["transactions_stream"] = f"""WITH {CONFORMED}
SELECT 'valid' AS outcome, order_id, transaction_timestamp, gross_amount, '' AS _reject_reason FROM valid
UNION ALL SELECT 'quarantine', order_id, transaction_timestamp, gross_amount, _reject_reason FROM quarantine"""

SQL["transactions_gold_by_category"] = f"""WITH {CONFORMED},
it AS (
  SELECT order_id, CAST(transaction_timestamp AS DATE) AS transaction_date, tax_rate,
    CASE WHEN regexp_matches(trim(raw_item_details), '^\\[(.*)\\]$')
          AND trim(regexp_extract(trim(raw_item_details), '^\\[(.*)\\]$', 1)) <> ''
         THEN string_split(regexp_extract(trim(raw_item_details), '^\\[(.*)\\]$', 1), '|') END AS parts
  FROM valid WHERE order_status = 'COMPLETED'),
ex AS (
  SELECT order_id, transaction_date, tax_rate, CAST(NULL AS BIGINT) AS item_id,
         CAST(NULL AS INTEGER) AS quantity, CAST(NULL AS DECIMAL(18,2)) AS unit_price
  FROM it WHERE parts IS NULL
  UNION ALL
  SELECT order_id, transaction_date, tax_rate,
         TRY_CAST(trim(string_split(parts[i], ':')[1]) AS BIGINT),
         TRY_CAST(trim(string_split(parts[i], ':')[2]) AS INTEGER),
         TRY_CAST(trim(string_split(parts[i], ':')[3]) AS DECIMAL(18,2))
  FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM it WHERE parts IS NOT NULL)),
cat AS (
  SELECT ex.*, COALESCE(p.p_type, 'Unknown') AS category,
         COALESCE(CAST(quantity AS DECIMAL(10,0)) * unit_price, CAST(0 AS DECIMAL(18,2))) AS line_revenue
  FROM ex LEFT JOIN part p ON ex.item_id = p.p_partkey),
daily AS (
  SELECT transaction_date, category, CAST(count(DISTINCT order_id) AS BIGINT) AS order_count,
         CAST(sum(line_revenue) AS DECIMAL(38,2)) AS daily_gross_revenue,
         CAST(sum(line_revenue * tax_rate) AS DECIMAL(38,6)) AS daily_tax_collected
  FROM cat WHERE transaction_date IS NOT NULL GROUP BY 1, 2)
SELECT *, avg(order_count) OVER (PARTITION BY category ORDER BY transaction_date
                                 ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling_7d_avg_orders
FROM daily"""

SQL["code_map"] = """WITH c AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS status_code,
         split_part(o_orderpriority, '-', 1) AS prio
  FROM orders)
SELECT o_orderkey, status_code,
       CASE status_code WHEN 'F' THEN 'Fulfilled' WHEN 'O' THEN 'Open'
            WHEN 'P' THEN 'Partially fulfilled' ELSE 'Other' END AS status_desc,
       CASE prio WHEN '1' THEN 'Urgent' WHEN '2' THEN 'High' WHEN '3' THEN 'Medium'
            WHEN '4' THEN 'Not specified' WHEN '5' THEN 'Low' ELSE 'Other' END AS priority_desc
FROM c"""

SQL["surrogate_keys"] = """WITH b AS (
  SELECT o_orderkey, 'O-' || o_orderkey AS order_id,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'C_' || o_custkey END AS cust_id,
         rpad('C' || o_custkey, 10, ' ') AS cust_char
  FROM orders)
SELECT o_orderkey,
       sha256(concat_ws('||', order_id, cust_id)) AS sk_transaction,
       sha256(concat_ws('||', COALESCE(order_id, '<NULL>'), COALESCE(cust_id, '<NULL>'))) AS sk_transaction_strict,
       md5(trim(cust_char)) AS sk_customer
FROM b"""

SQL["items_roundtrip"] = f"""WITH {RAW_ITEMS},
e AS (SELECT l_orderkey, l_linenumber, parts, unnest(generate_series(1, len(parts))) AS i
      FROM p WHERE parts IS NOT NULL)
SELECT l_orderkey, l_linenumber, CAST(NULL AS INTEGER) AS item_pos, CAST(NULL AS BIGINT) AS item_id,
       CAST(NULL AS INTEGER) AS quantity, CAST(NULL AS DECIMAL(18,2)) AS unit_price
FROM p WHERE parts IS NULL
UNION ALL
SELECT l_orderkey, l_linenumber, CAST(i - 1 AS INTEGER) AS item_pos,
       TRY_CAST(trim(string_split(parts[i], ':')[1]) AS BIGINT) AS item_id,
       TRY_CAST(trim(string_split(parts[i], ':')[2]) AS INTEGER) AS quantity,
       TRY_CAST(trim(string_split(parts[i], ':')[3]) AS DECIMAL(18,2)) AS unit_price
FROM e"""

SQL["item_totals"] = f"""WITH {RAW_ITEMS},
t AS (
  SELECT l_orderkey, l_linenumber, TRY_CAST(header_amount AS DECIMAL(18,2)) AS header_amount,
         CAST(COALESCE(list_sum(list_transform(parts, lambda x:
               TRY_CAST(trim(string_split(x, ':')[2]) AS INTEGER)
               * TRY_CAST(trim(string_split(x, ':')[3]) AS DECIMAL(18,2)))), 0) AS DECIMAL(18,2)) AS items_total,
         CAST(COALESCE(len(parts), 0) AS INTEGER) AS item_count
  FROM p)
SELECT *, COALESCE(header_amount = items_total, FALSE) AS amount_matches FROM t"""

SQL["customer_value_by_status"] = f"""WITH {RAW_ACCOUNTS},
a AS (
  SELECT customer_id, first_name, last_name, credit_score, account_status,
         CAST(sum(CASE WHEN account_status = 'Active' THEN current_balance ELSE 0 END) AS DECIMAL(25,2))
           AS active_balance,
         CAST(sum(current_balance) AS DECIMAL(25,2)) AS customer_lifetime_value,
         CAST(count(DISTINCT account_type) AS BIGINT) AS distinct_accounts
  FROM silver GROUP BY 1, 2, 3, 4, 5)
SELECT *, {TIER.format(v='customer_lifetime_value')} AS customer_tier,
       CASE WHEN account_status = 'Dormant' AND customer_lifetime_value > 1000 THEN TRUE ELSE FALSE END
         AS is_dormant_risk
FROM a"""

SQL["customer_value"] = f"""WITH {RAW_ACCOUNTS},
a AS (
  SELECT customer_id, max(first_name) AS first_name, max(last_name) AS last_name,
         max(credit_score) AS credit_score,
         CAST(sum(CASE WHEN account_status = 'Active' THEN current_balance ELSE 0 END) AS DECIMAL(25,2))
           AS active_balance,
         CAST(sum(CASE WHEN account_status = 'Dormant' THEN current_balance ELSE 0 END) AS DECIMAL(25,2))
           AS dormant_balance,
         CAST(sum(current_balance) AS DECIMAL(25,2)) AS customer_lifetime_value,
         CAST(count(DISTINCT account_type) AS BIGINT) AS distinct_accounts
  FROM silver GROUP BY 1)
SELECT *, {TIER.format(v='customer_lifetime_value')} AS customer_tier,
       CASE WHEN dormant_balance > 1000 THEN TRUE ELSE FALSE END AS is_dormant_risk
FROM a"""

SQL["rescue_json"] = f"""WITH {RAW_JSON}
SELECT event_id,
       TRY_CAST(trim(json_extract_string(CASE WHEN json_valid(value) THEN value END, '$.k')) AS INTEGER) AS k,
       CASE WHEN NOT json_valid(value) THEN value
            ELSE (SELECT CASE WHEN count(*) = 0 THEN NULL ELSE
                    '{{' || string_agg(to_json(je.key) || ':' ||
                        CASE WHEN je.type = 'NULL' THEN 'null'
                             ELSE to_json({_json_text('je.value', 'je.type')}) END, ',' ORDER BY je.id) || '}}'
                    END
                  FROM json_each(CASE WHEN json_valid(value) THEN value END) je
                  WHERE je.key <> 'k'
                     OR (je.type <> 'NULL'
                         AND TRY_CAST(trim({_json_text('je.value', 'je.type')}) AS INTEGER) IS NULL))
       END AS _rescued_data
FROM raw"""

SQL["split_valid"] = f"""WITH {FAULTY},
r AS (
  SELECT o_orderkey,
         concat_ws(';', CASE WHEN order_id IS NULL THEN 'missing:order_id' END,
                        CASE WHEN customer_id IS NULL THEN 'missing:customer_id' END,
                        CASE WHEN order_ts IS NULL THEN 'missing:order_ts' END,
                        CASE WHEN NOT COALESCE(amount >= 0, FALSE) THEN 'non_negative_amount' END) AS reason
  FROM f)
SELECT o_orderkey, CASE WHEN reason = '' THEN 'valid' ELSE 'quarantine' END AS outcome,
       reason AS _reject_reason
FROM r"""

SQL["dq_results"] = f"""WITH {FAULTY}
SELECT 'orders_silver' AS model, 'order_id' AS column_name, 'not_null' AS test,
       CAST(count(*) FILTER (WHERE order_id IS NULL) AS BIGINT) AS failures FROM f
UNION ALL
SELECT 'orders_silver', 'customer_id', 'not_null', CAST(count(*) FILTER (WHERE customer_id IS NULL) AS BIGINT) FROM f
UNION ALL
SELECT 'orders_silver', 'order_ts', 'not_null', CAST(count(*) FILTER (WHERE order_ts IS NULL) AS BIGINT) FROM f
UNION ALL
SELECT 'orders_silver', 'order_status', 'accepted_values',
       CAST(count(DISTINCT order_status) FILTER (WHERE order_status NOT IN ('F', 'O', 'P')) AS BIGINT) FROM f
UNION ALL
SELECT 'orders_silver', 'order_id', 'unique', CAST(count(*) AS BIGINT)
FROM (SELECT order_id FROM f WHERE order_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
UNION ALL
SELECT 'orders_silver', 'pair_id', 'unique', CAST(count(*) AS BIGINT)
FROM (SELECT pair_id FROM f WHERE pair_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
UNION ALL
SELECT 'orders_silver', 'customer_id', 'relationships', CAST(count(*) AS BIGINT)
FROM f WHERE customer_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = f.customer_id)"""

SQL["dq_failing_rows"] = f"""WITH {FAULTY},
t AS (
  SELECT o_orderkey, concat_ws(';',
    CASE WHEN order_id IS NULL THEN 'not_null:order_id' END, CASE WHEN customer_id IS NULL THEN 'not_null:customer_id' END,
    CASE WHEN order_ts IS NULL THEN 'not_null:order_ts' END, CASE WHEN order_status NOT IN ('F', 'O', 'P') THEN 'accepted_values:order_status' END,
    CASE WHEN order_id IS NOT NULL AND count(*) OVER (PARTITION BY order_id) > 1 THEN 'unique:order_id' END,
    CASE WHEN pair_id IS NOT NULL AND count(*) OVER (PARTITION BY pair_id) > 1 THEN 'unique:pair_id' END,
    CASE WHEN customer_id IS NOT NULL AND NOT EXISTS (
      SELECT 1 FROM customer c WHERE c.c_custkey = f.customer_id AND c.c_custkey % 11 <> 0) THEN 'relationships:customer_id' END) AS failed_tests
  FROM f)
SELECT o_orderkey, failed_tests FROM t WHERE failed_tests <> ''"""

SQL["orphans"] = """WITH x AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 53 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS cust_key
  FROM orders)
SELECT o_orderkey, cust_key FROM x
WHERE cust_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = x.cust_key)"""

SQL["star_fact"] = """WITH geo AS (
  SELECT n.n_nationkey, n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
dim AS (
  SELECT md5(trim(CAST(c.c_custkey AS VARCHAR))) AS sk_customer, c.c_mktsegment, g.n_name, g.r_name
  FROM customer c LEFT JOIN geo g ON c.c_nationkey = g.n_nationkey)
SELECT o.o_orderkey, md5(trim(CAST(o.o_custkey AS VARCHAR))) AS sk_customer, d.c_mktsegment, d.n_name, d.r_name,
       CAST(o.o_orderdate AS DATE) AS order_date, CAST(o.o_totalprice AS DECIMAL(18,2)) AS amount
FROM orders o LEFT JOIN dim d ON d.sk_customer = md5(trim(CAST(o.o_custkey AS VARCHAR)))"""

SQL["daily_active"] = """SELECT CAST(date_trunc('day', ts) AS DATE) AS period_start,
       CAST(count(DISTINCT user_id) AS BIGINT) AS active_users
FROM events WHERE ts IS NOT NULL GROUP BY 1"""

SQL["weekly_active"] = """SELECT CAST(date_trunc('week', ts) AS DATE) AS period_start,
       CAST(count(DISTINCT user_id) AS BIGINT) AS active_users
FROM events WHERE ts IS NOT NULL GROUP BY 1"""

SQL["recurring_revenue"] = f"""WITH {COMPLETED_TX},
m AS (
  SELECT customer_id AS customer, CAST(date_trunc('month', CAST(transaction_timestamp AS DATE)) AS DATE) AS month,
         sum(gross_amount) AS revenue
  FROM tx WHERE transaction_timestamp IS NOT NULL AND customer_id IS NOT NULL GROUP BY 1, 2),
l AS (SELECT *, lag(month) OVER (PARTITION BY customer ORDER BY month) AS prev_month FROM m)
SELECT month, CAST(count(*) AS BIGINT) AS recurring_customers,
       CAST(sum(revenue) AS DECIMAL(28,2)) AS recurring_revenue
FROM l WHERE prev_month = CAST(month - INTERVAL 1 MONTH AS DATE) GROUP BY 1"""

SQL["extract_blocks"] = f"""WITH {FENCED}
SELECT conv_id, turn, {_extract('reply', 'sql')} AS sql_block, {_extract('reply', 'yaml')} AS yaml_block,
       {_extract('reply', 'python')} AS python_block
FROM t"""

SQL["reconcile_layers"] = f"""WITH {CONFORMED},
t AS (
  SELECT _source_file, 'rows_in' AS layer, customer_id FROM tagged
  UNION ALL SELECT _source_file, 'kept', customer_id FROM valid
  UNION ALL SELECT _source_file, 'superseded', customer_id FROM ranked WHERE order_id IS NOT NULL AND place > 1
  UNION ALL SELECT _source_file, 'quarantined', customer_id FROM quarantine),
c AS (
  SELECT flow, _source_file, CAST(count(*) FILTER (layer = 'rows_in') AS BIGINT) AS rows_in,
         CAST(count(*) FILTER (layer = 'kept' AND (flow = 'whole' OR customer_id IS NOT NULL)) AS BIGINT) AS kept,
         CAST(count(*) FILTER (layer = 'superseded') AS BIGINT) AS superseded,
         CAST(count(*) FILTER (layer = 'quarantined') AS BIGINT) AS quarantined
  FROM t, (VALUES ('whole'), ('lossy')) AS f(flow) GROUP BY 1, 2)
SELECT *, rows_in - kept - superseded - quarantined AS unexplained,
       rows_in - kept - superseded - quarantined = 0 AS balanced
FROM c"""

SQL["reconcile_content"] = f"""WITH r AS ({SQL["reconcile_layers"]})
SELECT f.flow, r.* EXCLUDE (flow), f.flow = 'whole' OR kept = 0 AS content_balanced
FROM r, (VALUES ('whole'), ('changed')) AS f(flow) WHERE r.flow = 'whole'"""

# The SQL model computes the same result as its DataFrame twin.
SQL["recurring_revenue_sql"] = SQL["recurring_revenue"]

SQL["conform_customers"] = f"""WITH {RAW_ACCOUNTS}
SELECT md5(trim(CUST_ID)) AS sk_customer, trim(CUST_ID) AS customer_id, trim(FIRST_NAME) AS first_name,
       trim(MID_INIT) AS middle_initial, trim(LAST_NAME) AS last_name,
       CAST(try_strptime(trim(OPEN_DT), '%Y%m%d') AS DATE) AS account_open_date,
       CASE trim(ACCT_TYPE) WHEN 'SV' THEN 'Savings' WHEN 'CH' THEN 'Checking'
            WHEN 'CD' THEN 'Certificate of Deposit' ELSE 'Unknown' END AS account_type,
       TRY_CAST(trim(CAST(CURR_BAL AS VARCHAR)) AS DECIMAL(15,2)) AS current_balance,
       TRY_CAST(trim(CAST(CR_SCORE AS VARCHAR)) AS INTEGER) AS credit_score,
       CASE trim(STATUS_CD) WHEN 'A' THEN 'Active' WHEN 'I' THEN 'Inactive'
            WHEN 'D' THEN 'Dormant' ELSE 'Other' END AS account_status
FROM raw"""

SQL["accounts_by_type"] = f"""WITH {RAW_ACCOUNTS}
SELECT customer_id,
       CAST(sum(CASE WHEN account_type = 'Savings' THEN current_balance END) AS DECIMAL(25,2)) AS savings,
       CAST(sum(CASE WHEN account_type = 'Checking' THEN current_balance END) AS DECIMAL(25,2)) AS checking,
       CAST(sum(CASE WHEN account_type = 'Certificate of Deposit' THEN current_balance END) AS DECIMAL(25,2))
         AS certificate_of_deposit,
       CAST(sum(CASE WHEN account_type = 'Unknown' THEN current_balance END) AS DECIMAL(25,2)) AS unknown
FROM silver GROUP BY customer_id"""

SQL["code_map_table"] = """WITH c AS (
  SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS nation_code
  FROM customer)
SELECT c.c_custkey, c.nation_code, COALESCE(n.n_name, 'Unknown') AS nation_name
FROM c LEFT JOIN nation n ON c.nation_code = n.n_nationkey"""
