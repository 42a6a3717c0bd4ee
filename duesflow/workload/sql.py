"""SQL fragments shared by the check queries. Amounts are exact: decimals, or
whole cents where a division has to be rounded."""

ACCOUNT = "lpad(CAST({0} AS VARCHAR), 22, '0')"


def account(column: str) -> str:
    return ACCOUNT.format(column)


def cents(column: str) -> str:
    return f"CAST(round({column} * 100) AS BIGINT)"


def money(column: str) -> str:
    return f"CAST({column} AS DECIMAL(18,2))"


def half_up(numerator: str, denominator: str) -> str:
    """Rounded division of a numerator that is not negative."""
    return f"((2 * ({numerator}) + ({denominator})) // (2 * ({denominator})))"


def signed_half_up(numerator: str, denominator: int) -> str:
    up = half_up(f"abs({numerator})", str(denominator))
    return f"(CASE WHEN ({numerator}) < 0 THEN -{up} ELSE {up} END)"


# (b, d, amt, extra, firm, okey, ln, status): every cost with its building
COST = f"""cost AS (
  SELECT s_nationkey AS b, CAST(l_shipdate AS DATE) AS d, {money('l_extendedprice')} AS amt,
         l_returnflag = 'R' AS extra, s_name AS firm, l_orderkey AS okey, l_linenumber AS ln,
         l_linestatus AS status
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""

# (id, u, d, amt, b, dep): every payment with its unit and building
PAID = f"""paid AS (
  SELECT o_orderkey AS id, o_custkey AS u, CAST(o_orderdate AS DATE) AS d,
         {money('o_totalprice')} AS amt, c_nationkey AS b, substr(c_mktsegment, 1, 1) AS dep
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

# (id, u, b, dep, d, m, wo, we, wm, total, got): one bill line per order, in cents
LINES = f"""weights AS (
  SELECT l_orderkey AS id,
         CAST(sum(CASE WHEN l_returnflag <> 'R' THEN {cents('l_extendedprice')} END) AS BIGINT) AS wo,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN {cents('l_extendedprice')} END) AS BIGINT) AS we,
         CAST(sum({half_up(f"{cents('l_extendedprice')} * {cents('l_tax')}", '100')}) AS BIGINT) AS wm
  FROM lineitem GROUP BY l_orderkey),
lines AS (
  SELECT o_orderkey AS id, o_custkey AS u, c_nationkey AS b, substr(c_mktsegment, 1, 1) AS dep,
         CAST(o_orderdate AS DATE) AS d, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, wo, we, wm,
         coalesce(wo, 0) + coalesce(we, 0) + coalesce(wm, 0) AS total, {cents('o_totalprice')} AS got
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN weights ON weights.id = o_orderkey)"""

PERIOD_KEY = "({0} * 1000000 + year({1}) * 100 + month({1}))"


def period_key(owner: str, period: str) -> str:
    return PERIOD_KEY.format(f"CAST({owner} AS BIGINT)", period)


# Billing, all in cents: units with percentages, grid, headers, carried lines.
UNITS = f"""units AS (
  SELECT c_custkey AS u, c_nationkey AS b, substr(c_mktsegment, 1, 1) AS dep,
         greatest({cents('c_acctbal')}, 0) AS m2 FROM customer),
areas AS (SELECT b, CAST(sum(m2) AS BIGINT) AS area FROM units GROUP BY b),
shared AS (
  SELECT u, units.b, dep, CASE WHEN area > 0 THEN {half_up('m2 * 10000', 'area')} END AS pct
  FROM units JOIN areas ON units.b = areas.b)"""

GRID = """grid AS (
  SELECT n_nationkey AS b, CAST(p AS DATE) AS p FROM nation,
         (SELECT unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS p FROM (
            SELECT date_trunc('month', least((SELECT min(o_orderdate) FROM orders), (SELECT min(l_shipdate) FROM lineitem))) AS lo,
                   date_trunc('month', greatest((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem))) AS hi)))"""

HEADERS = f"""{COST}, {PAID}, {GRID},
spent AS (
  SELECT b, CAST(date_trunc('month', d) AS DATE) AS p,
         CAST(coalesce(sum(CASE WHEN NOT extra THEN amt END), 0) * 100 AS BIGINT) AS o,
         CAST(coalesce(sum(CASE WHEN extra THEN amt END), 0) * 100 AS BIGINT) AS e
  FROM cost GROUP BY ALL),
earned AS (
  SELECT b, CAST(date_trunc('month', d) AS DATE) AS p, CAST(sum(amt) * 100 AS BIGINT) AS got,
         CAST(coalesce(sum(CASE WHEN day(d) >= 10 THEN amt END), 0) * 100 AS BIGINT) AS late,
         CAST(coalesce(sum(CASE WHEN day(d) > 15 THEN amt END), 0) * 100 AS BIGINT) AS ahead
  FROM paid GROUP BY ALL),
opening AS (SELECT s_nationkey AS b, CAST(sum({money('s_acctbal')}) * 100 AS BIGINT) AS saldo
            FROM supplier GROUP BY s_nationkey),
flow AS (
  SELECT g.b, g.p, coalesce(saldo, 0) AS apertura, coalesce(e1.got, 0) AS got, coalesce(e1.late, 0) AS late,
         coalesce(e0.ahead, 0) AS ahead, coalesce(s.o, 0) AS o, coalesce(s.e, 0) AS e
  FROM grid g LEFT JOIN earned e1 ON e1.b = g.b AND e1.p = g.p
       LEFT JOIN earned e0 ON e0.b = g.b AND e0.p = g.p - INTERVAL 1 MONTH
       LEFT JOIN spent s ON s.b = g.b AND s.p = g.p LEFT JOIN opening ON opening.b = g.b),
headers AS (
  SELECT *, apertura + sum(got - o - e) OVER (PARTITION BY b ORDER BY p) AS cierre FROM flow)"""

_EXACT = "(h.o + h.e) * coalesce(s.pct, 0) + {debt} * 10000 + greatest({debt}, 0) * 500"

# carried: one row per unit and month, debts carried on
CARRIED = f"""{UNITS}, {HEADERS},
settled AS (
  SELECT u, CAST(date_trunc('month', d) - INTERVAL 1 MONTH AS DATE) AS p,
         CAST(sum(amt) * 100 AS BIGINT) AS got, min(d) AS first_paid FROM paid GROUP BY ALL),
carried(u, b, p, so, se, debt, total, got, first_paid, got_before) AS (
  SELECT s.u, s.b, h.p, {half_up('h.o * coalesce(s.pct, 0)', '10000')}, {half_up('h.e * coalesce(s.pct, 0)', '10000')},
         CAST(0 AS BIGINT), CAST({signed_half_up(_EXACT.format(debt='0'), 10000)} AS BIGINT),
         coalesce(t.got, 0), t.first_paid, CAST(NULL AS BIGINT)
  FROM shared s JOIN headers h ON h.b = s.b LEFT JOIN settled t ON t.u = s.u AND t.p = h.p
  WHERE h.p = (SELECT min(p) FROM grid)
  UNION ALL
  SELECT s.u, s.b, h.p, {half_up('h.o * coalesce(s.pct, 0)', '10000')}, {half_up('h.e * coalesce(s.pct, 0)', '10000')},
         c.total - c.got, CAST({signed_half_up(_EXACT.format(debt='(c.total - c.got)'), 10000)} AS BIGINT),
         coalesce(t.got, 0), t.first_paid, c.got
  FROM carried c JOIN shared s ON s.u = c.u
       JOIN headers h ON h.b = c.b AND h.p = c.p + INTERVAL 1 MONTH
       LEFT JOIN settled t ON t.u = s.u AND t.p = h.p),
refreshed AS (
  SELECT *, coalesce(got_before, debt) AS before,
         CASE WHEN first_paid IS NULL THEN {half_up('greatest(debt, 0) * 5', '100')}
              WHEN first_paid > p + INTERVAL 14 DAY
                THEN {signed_half_up('(total - coalesce(got_before, debt)) * 5', 100)}
              WHEN first_paid > p + INTERVAL 9 DAY
                THEN {signed_half_up('(total - coalesce(got_before, debt)) * 2', 100)}
              ELSE 0 END AS interest
  FROM carried)"""


def draw(row: str, seed: int) -> str:
    """The integer draw of ``functions.picks`` in SQL."""
    return (f"(((((CAST({row} AS BIGINT) % 2147483647) * {48271 + seed} + {seed * 7919 + 1})"
            f" % 2147483647) * 69621) % 2147483647)")


def draw_below(row: str, seed: int, bound: int) -> str:
    return f"({draw(row, seed)} % {bound})"


def pick(row: str, seed: int, values) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[{draw_below(row, seed, len(values))} + 1]"
