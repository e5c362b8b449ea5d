"""Pieces of the oracles' SQL (DuckDB): the panels, edges, bins and divergences, written independently of the operators."""

from __future__ import annotations

RETAIL = """retail AS (
  SELECT CAST(l_partkey AS VARCHAR) AS item_id, p_type || '#' || p_brand AS dept_id, p_type AS cat_id, n_name AS store_id, r_name AS state_id,
         CAST(l_shipdate AS DATE) AS date, CAST(l_quantity AS DOUBLE) AS sales, l_extendedprice / l_quantity AS sell_price, l_extendedprice AS revenue
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
EVENTS = """ev AS (
  SELECT event_type || '#' || CAST(user_id % 20 AS VARCHAR) AS item_id, event_type AS dept_id,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'CONVERSION' ELSE 'TRAFFIC' END AS cat_id,
         CAST(user_id % 10 AS VARCHAR) AS store_id, CAST(user_id % 2 AS VARCHAR) AS state_id, CAST(ts AS DATE) AS date, value AS sales, 1.0::DOUBLE AS sell_price, value AS revenue
  FROM events)"""
RETAIL_REF, RETAIL_CUR = "date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'", "date BETWEEN DATE '2001-01-01' AND DATE '2001-10-31'"
EVENT_REF, EVENT_CUR = "date BETWEEN DATE '2024-01-01' AND DATE '2024-01-20'", "date BETWEEN DATE '2024-01-21' AND DATE '2024-01-30'"


def tagged(name: str, source: str, ref: str, cur: str) -> str:
    return f"{name} AS (SELECT *, CASE WHEN {ref} THEN 'ref' ELSE 'cur' END AS win FROM {source} WHERE {ref} OR {cur})"


def edges(name: str, source: str, value: str, by: str = "") -> str:
    """Adaptive edges of `value`: a row, or one for each `by`."""
    marks = ", ".join(str(i / 20) for i in range(21))
    pick, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""{name}_s AS (
  SELECT {pick}quantile_cont({value}, [{marks}]) AS q, quantile_cont({value}, 0.99) AS q99, min({value}) AS lo, max({value}) AS hi,
         bool_and(abs({value} - round_even({value}, 0)) <= 1e-6 + 1e-5 * abs(round_even({value}, 0))) AS whole
  FROM {source} WHERE {value} IS NOT NULL {group}),
{name}_c AS (SELECT *, greatest(1, CAST(floor(q99) AS INT)) AS cap FROM {name}_s),
{name}_e AS (
  SELECT {pick}lo, hi, CASE WHEN whole AND cap <= 20
    THEN list_concat(list_transform(range(0, cap + 2), lambda e: CAST(e AS DOUBLE)), CASE WHEN hi > cap + 1 THEN [CAST(hi + 1 AS DOUBLE)] ELSE [] END)
    ELSE list_sort(list_distinct(list_transform(q, lambda e: round(e, 6)))) END AS e
  FROM {name}_c),
{name} AS (SELECT {pick}CASE WHEN len(e) < 2 THEN [CAST(lo AS DOUBLE), CAST(hi + 1 AS DOUBLE)] ELSE e END AS e FROM {name}_e)"""


def bin_of(x: str, e: str = "e") -> str:
    return f"len(list_filter({e}[2:len({e}) - 1], lambda z: {x} >= z))"


def js(keys: str, source: str, name: str) -> str:
    """name: keys, js, l_inf, r, c from rows keys, bin, r, c."""
    part = f"PARTITION BY {keys}" if keys else ""
    pick, group = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    return f"""{name}_p AS (SELECT *, r / nullif(sum(r) OVER ({part}), 0)::DOUBLE AS p, c / nullif(sum(c) OVER ({part}), 0)::DOUBLE AS q FROM {source}),
{name} AS (
  SELECT {pick}coalesce(sum(0.5 * (CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)), 0) AS js,
         coalesce(max(abs(p - q)), 0) AS l_inf, CAST(sum(r) AS BIGINT) AS r, CAST(sum(c) AS BIGINT) AS c
  FROM {name}_p {group})"""


COUNTS = "count(*) FILTER (win = 'ref') AS r, count(*) FILTER (win = 'cur') AS c"


def slices(name: str, source: str, keep: str, columns: tuple[str, ...]) -> str:
    order = {"cat_id": 0, "dept_id": 1, "state_id": 2, "store_id": 3, "item_id": 4}
    return f"{name} AS (" + " UNION ALL ".join(f"SELECT {keep}, '{c}' AS slice_col, {order[c]} AS slice_ord, CAST({c} AS VARCHAR) AS slice_val FROM {source} WHERE {c} IS NOT NULL" for c in columns) + ")"


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, _i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
