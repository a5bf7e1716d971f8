"""The registered queries once more, as SQL that DuckDB runs on the same tables.

These are written from the rules and not from the Spark code: averages by
recursion, amounts by a running product over every bar, no blocks or chunks.
"""

from __future__ import annotations

from tapecheck.constants import (
    BASELINE_CELL,
    COST_SCENARIOS,
    FAST_PERIODS,
    INITIAL_CASH,
    REGISTRY_COLUMNS,
    REGISTRY_REQUIRED,
    SLOW_PERIODS,
    SPOT_CHECKS,
)
from tapecheck.plans import workload as w

GRID = [(f, s) for f in FAST_PERIODS for s in SLOW_PERIODS]
ALLOWED = "(ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '2001-01-01')"
BASELINE = {"baseline": COST_SCENARIOS["baseline"]}
START, END = "TIMESTAMP '1996-01-01'", "TIMESTAMP '2001-01-01'"
RUN = "symbol, fast, slow, scenario"
WINDOWS_CTE = """wins AS (
  SELECT y::INTEGER AS "window", make_timestamp(y, 1, 1, 0, 0, 0) AS start,
         make_timestamp(y + 1, 1, 1, 0, 0, 0) AS "end"
  FROM (VALUES (1996), (1997), (1998), (1999), (2000)) v(y))"""


def bars(symbol: str = "l_returnflag") -> str:
    return f"""ticks AS (
  SELECT {symbol}::VARCHAR AS symbol, l_shipdate AS ts,
         100 + (l_extendedprice / l_quantity) / 1000 AS px, l_quantity AS qty,
         {{'o': l_orderkey, 'n': l_linenumber, 'p': l_partkey, 's': l_suppkey,
           'x': 100 + (l_extendedprice / l_quantity) / 1000}} AS seq
  FROM lineitem),
bars AS (
  SELECT symbol, ts, arg_min(px, seq) AS open, max(px) AS high, min(px) AS low,
         arg_max(px, seq) AS close, sum(qty) AS volume
  FROM ticks GROUP BY symbol, ts)"""


def averages(periods, source: str = "bars", keys: str = "symbol") -> str:
    """Recursive averages ``e<p>`` over the rows of ``source``."""
    a = {p: 2.0 / (p + 1) for p in periods}
    seed = ", ".join(f"close AS e{p}" for p in periods)
    step = ", ".join(f"{a[p]!r}::DOUBLE * n.close + {1 - a[p]!r}::DOUBLE * e.e{p}" for p in periods)
    same = " AND ".join(f"n.{k.strip()} = e.{k.strip()}" for k in keys.split(","))
    cols = ", ".join(f"n.{k.strip()}" for k in keys.split(","))
    return f"""num AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts) - 1 AS idx FROM {source}),
ema AS (
  SELECT {keys}, idx, {seed} FROM num WHERE idx = 0
  UNION ALL
  SELECT {cols}, n.idx, {step} FROM ema e JOIN num n ON {same} AND n.idx = e.idx + 1)"""


def states(grid, keys: str = "symbol") -> str:
    """Signals and targets per cell: ``st``."""
    using = ", ".join(k.strip() for k in keys.split(","))
    parts = "\n  UNION ALL ".join(
        f"SELECT {keys}, idx, ts, open, close, {f} AS fast, {s} AS slow, "
        f"CASE WHEN idx >= {s - 1} AND e{f} > e{s} THEN 1 ELSE 0 END AS signal FROM num JOIN ema USING ({using}, idx)"
        for f, s in grid
    )
    over = f"OVER (PARTITION BY {keys}, fast, slow ORDER BY ts)"
    return f"""sig AS ({parts}),
st AS (
  SELECT *, lag(signal, 1, 0) {over} AS target, lag(signal, 2, 0) {over} AS prev_target,
         lag(close) {over} AS prev_close FROM sig)"""


def book(costs, keys: str = "symbol") -> str:
    """Amounts, curve, fills and trips of every cell and scenario."""
    values = ", ".join(f"('{n}', {c!r}::DOUBLE, {s!r}::DOUBLE)" for n, (c, s) in costs.items())
    over = f"OVER (PARTITION BY {keys}, fast, slow, scenario ORDER BY ts ROWS UNBOUNDED PRECEDING)"
    series = f"OVER (PARTITION BY {keys}, fast, slow, scenario ORDER BY ts)"
    return f"""costs(scenario, c, s) AS (VALUES {values}),
fac AS (
  SELECT st.*, scenario, c, s,
         CASE WHEN target = 1 THEN open * (1 + s) ELSE open * (1 - s) END AS price,
         CASE WHEN target = prev_target THEN 1.0
              WHEN target = 1 THEN 1 / ((open * (1 + s)) * (1 + c))
              ELSE open * (1 - s) * (1 - c) END AS f
  FROM st CROSS JOIN costs),
amt AS (SELECT *, {INITIAL_CASH!r}::DOUBLE * product(f) {over} AS amount FROM fac),
val AS (
  SELECT *, CASE WHEN target = 1 THEN 0.0 ELSE amount END AS cash,
         CASE WHEN target = 1 THEN amount ELSE 0.0 END AS units,
         CASE WHEN target = 1 THEN amount * close ELSE 0.0 END AS position_value,
         CASE WHEN target = 1 THEN amount * close ELSE amount END AS equity FROM amt),
curve AS (SELECT *, lag(equity) {series} AS prev_equity, lag(amount) {series} AS prev_amount FROM val),
fills AS (
  SELECT *, CASE WHEN target = 1 THEN 'buy' ELSE 'sell' END AS side,
         CASE WHEN target = 1 THEN amount ELSE prev_amount END AS quantity FROM curve
  WHERE target <> prev_target),
paired AS (
  SELECT *, quantity * price * c AS commission,
         lead(ts) {series} AS exit_ts, lead(price) {series} AS exit_price,
         lead(quantity * price * c) {series} AS exit_commission FROM fills),
trips AS (
  SELECT {keys}, fast, slow, scenario, ts AS entry_ts, exit_ts, price AS entry_price, exit_price,
         quantity, commission AS entry_commission, exit_commission,
         row_number() {series} AS trip,
         (exit_price - price) * quantity - commission - exit_commission AS realized_pnl
  FROM paired WHERE side = 'buy')"""


def study(grid=(BASELINE_CELL,), costs=BASELINE, symbol: str = "l_returnflag", research: bool = True) -> str:
    periods = sorted({p for cell in grid for p in cell})
    source = f"research AS (SELECT * FROM bars WHERE {ALLOWED if research else 'true'})"
    return (
        f"WITH RECURSIVE {bars(symbol)}, {source}, {averages(periods, 'research')}, "
        f"{states(grid)}, {book(costs)}, {WINDOWS_CTE}"
    )


BARS, SUPPLIER_BARS = f"WITH {bars()}", f"WITH {bars('l_suppkey')}"


def gate(name: str, n: str, required: int) -> str:
    """Required and actual number of observations, where there are too few."""
    few = f"coalesce({n}, 0) < {required}"
    return (
        f"CASE WHEN {few} THEN {required} END::INTEGER AS {name}_required, "
        f"CASE WHEN {few} THEN coalesce({n}, 0) END::BIGINT AS {name}_actual"
    )


RETURNS = f"""edge AS (
  SELECT {RUN}, "window",
         arg_max(equity, ts) FILTER (ts < start) AS start_equity,
         arg_max(equity, ts) FILTER (ts < "end") AS end_equity
  FROM curve CROSS JOIN wins GROUP BY ALL),
ret AS (SELECT *, end_equity / start_equity - 1 AS r FROM edge),
agg AS (SELECT {RUN}, CASE WHEN count(r) = 5 THEN product(1 + r) - 1 END AS a FROM ret GROUP BY ALL)"""
WINDOW_COLUMNS = """"window", round(r, 8) AS window_return, round(a, 8) AS aggregate_return,
        CASE WHEN start_equity IS NULL THEN 'no_equity_before_start' ELSE 'ok' END AS status,
        CASE WHEN a IS NULL THEN 'missing_window' ELSE 'ok' END AS aggregate_status"""
NEIGHBORS = f"""cell AS (
  SELECT symbol, fast, slow, a, list_position({list(FAST_PERIODS)}, fast) - 1 AS fi,
         list_position({list(SLOW_PERIODS)}, slow) - 1 AS si FROM agg),
nb AS (
  SELECT x.symbol, x.fast, x.slow, x.fi, x.si, y.fi AS nfi, y.si AS nsi, x.a,
         y.fast AS n_fast, y.slow AS n_slow, y.a AS b
  FROM cell x JOIN cell y ON x.symbol = y.symbol AND abs(x.fi - y.fi) + abs(x.si - y.si) = 1)"""
GRID_STUDY = f"{study(GRID)}, {RETURNS}"
GRID_PAIRS = f"{GRID_STUDY}, {NEIGHBORS}"
ONE = study()


def fixed_text(c: str) -> str:
    u = f"CAST(floor({c} * 10000) AS BIGINT)"
    return f"(({u} // 10000)::VARCHAR || '.' || lpad(({u} % 10000)::VARCHAR, 4, '0'))"


RAW = f"""raw AS (
  SELECT symbol AS product, ts::DATE AS "day", (ts::DATE - DATE '1970-01-01')::BIGINT AS d,
         ((ts::DATE - DATE '1970-01-01')::BIGINT * 86400)::VARCHAR AS start,
         {fixed_text('low')} AS low, {fixed_text('high')} AS high, {fixed_text('open')} AS open,
         {fixed_text('close')} AS close, {fixed_text('volume')} AS volume FROM bars)"""
FLOOR_D = "(DATE '1995-01-01' - DATE '1970-01-01')::BIGINT"
PAGES = f"""pg AS (
  SELECT *, ((d - {FLOOR_D}) // 300)::INTEGER AS page_no, max(d) OVER (PARTITION BY product) AS last_d FROM raw),
pages_ AS (
  SELECT product, page_no, max(last_d) AS last_d, count(*) AS n,
         {FLOOR_D} + page_no * 300 AS first_d,
         {FLOOR_D} + page_no * 300 + CASE WHEN page_no % 7 = 3 THEN 1 ELSE 0 END AS req_d,
         least({FLOOR_D} + page_no * 300 + 299, max(last_d)) AS end_d
  FROM pg GROUP BY product, page_no)"""
PLAN = """planned AS (
  SELECT symbol, k::INTEGER AS page_no, f AS first_day, least(f + 299, last_day) AS last_day
  FROM (SELECT symbol, max(ts)::DATE + 2 AS last_day FROM bars GROUP BY symbol)
  CROSS JOIN LATERAL (SELECT unnest(range(0, ((last_day - DATE '1995-01-01') // 300) + 1)) AS k)
  CROSS JOIN LATERAL (SELECT (DATE '1995-01-01' + (k * 300)::INTEGER) AS f))"""
FAULTY = f"""{RAW},
src AS (SELECT *, max("day") OVER (PARTITION BY product)::TIMESTAMP + INTERVAL 12 HOUR AS now FROM raw),
cand AS (
  SELECT product, d, copy, now,
         greatest(0, ((d - {FLOOR_D}) // 300) - CASE WHEN d % 59 = 0 THEN 1 ELSE 0 END) AS page_no,
         CASE WHEN d % 41 = 0 THEN (start::BIGINT + 3600)::VARCHAR ELSE start END AS start,
         d % 41 = 0 AS bad_start, d % 43 = 0 AS bad_low, open, high, low, close, volume
  FROM src CROSS JOIN LATERAL (SELECT unnest(CASE WHEN d % 47 = 0 THEN [0, 1] ELSE [0] END) AS copy)),
judged AS (
  SELECT *, 30000 - d + copy * 100000 AS pos,
         CASE WHEN bad_start THEN 'malformed:start_not_midnight'
              WHEN bad_low THEN 'malformed:low_not_finite'
              WHEN NOT d BETWEEN {FLOOR_D} + page_no * 300 AND {FLOOR_D} + page_no * 300 + 299 THEN 'outside_window'
              WHEN copy = 1 THEN 'duplicate_bucket'
              WHEN make_timestamp(d * 86400000000) + INTERVAL 1 DAY > now THEN 'incomplete_bucket' END AS reject
  FROM cand)"""


def plain_decimal(c: str) -> str:
    """Digits and power of ten of a four-place decimal text."""
    z = f"rtrim(ltrim(replace({c}, '.', ''), '0'), '0')"
    return (
        f"CASE WHEN {z} = '' THEN '0' ELSE {z} || 'E' || "
        f"(length(ltrim(replace({c}, '.', ''), '0')) - length({z}) - 4)::VARCHAR END"
    )


SNAPSHOTS = f"""{RAW},
base AS (SELECT * FROM raw WHERE d % 89 <> 0),
aud AS (
  SELECT product, "day", d, start, low, high, open,
         CASE WHEN d % 53 = 0 THEN close || '1' WHEN d % 31 = 0 THEN close || '0' ELSE close END AS close, volume
  FROM raw WHERE d % 97 <> 0),
refs AS (SELECT product, max("day") + 1 AS ref FROM base GROUP BY product),
pairs AS (
  SELECT product, "day", ref - "day" AS age, b.d AS bd, a.d AS ad, b.close AS bc, a.close AS ac,
         to_json({{'start': b.start, 'low': b.low, 'high': b.high, 'open': b.open, 'close': b.close, 'volume': b.volume}})::VARCHAR AS bj,
         to_json({{'start': a.start, 'low': a.low, 'high': a.high, 'open': a.open, 'close': a.close, 'volume': a.volume}})::VARCHAR AS aj
  FROM base b FULL OUTER JOIN aud a USING (product, "day") JOIN refs USING (product) WHERE "day" < ref),
kinds AS (
  SELECT *, CASE WHEN age = 1 THEN '1' WHEN age <= 7 THEN '2-7' WHEN age <= 30 THEN '8-30' ELSE '>30' END AS bucket,
         CASE WHEN bd IS NULL THEN 'audit_only' WHEN ad IS NULL THEN 'baseline_only'
              WHEN bc = ac THEN NULL
              WHEN bc::DECIMAL(30, 10) <> ac::DECIMAL(30, 10) THEN 'value' ELSE 'format_only' END AS kind
  FROM pairs)"""

CATALOG = """base AS (
  SELECT o_orderkey, o_orderkey::VARCHAR AS key, 'C' || o_custkey::VARCHAR AS symbol,
         CASE WHEN o_orderkey % 211 <> 0 THEN o_orderdate + CASE WHEN o_orderkey % 4 = 1 THEN INTERVAL 18 HOUR ELSE INTERVAL 0 HOUR END END AS created_at,
         CASE WHEN o_orderkey % 211 <> 0 THEN o_orderdate END AS written_at,
         sha256('raw-' || o_orderkey::VARCHAR) AS raw_sha FROM orders),
raw AS (SELECT *, 'raw/' || symbol || '/1d/' || key || '.parquet' AS path FROM base),
proc AS (
  SELECT *, 'processed/acme/' || symbol || '/1d/' || key || '.canonical.parquet' AS path,
         CASE WHEN o_orderkey % 23 = 0 THEN symbol || 'x' ELSE symbol END AS recorded,
         CASE WHEN o_orderkey % 17 = 0 THEN sha256('lost-' || key) ELSE raw_sha END AS source_raw_sha256 FROM base)"""

REGISTRY = """rec AS (
  SELECT 'exp-' || o_orderkey::VARCHAR AS experiment_id, strftime(o_orderdate, '%Y-%m-%d') AS "date",
         CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE sha256(o_orderkey::VARCHAR) END AS git_commit,
         CASE WHEN o_orderkey % 3 = 0 THEN 'false' ELSE 'true' END AS working_tree_clean,
         CASE WHEN o_orderkey % 19 = 0 THEN 'draft' WHEN o_orderkey % 2 = 0 THEN 'dev' ELSE 'finalized' END AS record_status,
         'says "stable", ' || o_orderpriority AS hypothesis,
         '{"fast":' || (o_orderkey % 12 + 1)::VARCHAR || '}' AS params_json,
         CASE WHEN o_orderkey % 17 = 0 THEN '{"python":"3","pandas":"2","pyarrow":"1","vectorbt":"0"} and more'
              WHEN o_orderkey % 13 = 0 THEN '[1, 2]' WHEN o_orderkey % 11 = 0 THEN 'not json'
              WHEN o_orderkey % 7 = 0 THEN '{"python":"3","pandas":"2"}'
              ELSE '{"python":"3","pandas":"2","pyarrow":"1","vectorbt":"0"}' END AS dependency_versions_json,
         'false' AS test_evaluated, o_orderstatus
  FROM orders)"""
REGISTRY_TEXT = {
    "experiment_id", "date", "git_commit", "working_tree_clean", "record_status", "hypothesis",
    "params_json", "dependency_versions_json", "test_evaluated",
}
REGISTRY_LITERAL = [c for c in REGISTRY_REQUIRED if c not in REGISTRY_TEXT]
JUDGED = """judged AS (
  SELECT *, record_status = 'finalized' AS final, json_valid(dependency_versions_json) AS valid FROM rec),
broken AS (
  SELECT experiment_id, 'unknown_status' AS rule FROM judged WHERE record_status NOT IN ('finalized', 'dev')
  UNION ALL SELECT experiment_id, 'missing_git_commit' FROM judged WHERE final AND git_commit = ''
  UNION ALL SELECT experiment_id, 'working_tree_not_clean' FROM judged WHERE final AND working_tree_clean <> 'true'
  UNION ALL SELECT experiment_id, 'versions_not_json' FROM judged WHERE final AND NOT valid
  UNION ALL SELECT experiment_id, 'versions_not_object' FROM judged WHERE final AND dependency_versions_json LIKE '[%'
  UNION ALL SELECT experiment_id, 'versions_key_missing' FROM judged
    WHERE final AND dependency_versions_json LIKE '{%' AND dependency_versions_json NOT LIKE '%vectorbt%')"""


def registry_columns() -> str:
    def one(c: str) -> str:
        if c in REGISTRY_TEXT:
            return f'"{c}"'
        return f"'{c if c in REGISTRY_LITERAL else ''}' AS \"{c}\""

    return ", ".join(one(c) for c in REGISTRY_COLUMNS)


def migrated_columns() -> str:
    given = {"experiment_id": '"experiment_id"', "date": '"date"', "params_json": "params_json",
             "outcome": "o_orderstatus", "record_status": "'dev'"}
    return ", ".join(f'{given.get(c, chr(39) * 2)} AS "{c}"' for c in REGISTRY_COLUMNS)


def rounded(ratios: str = "", money: str = "") -> str:
    return ", ".join(
        [f"round({c}, 8) + 0.0 AS {c}" for c in ratios.split()] + [f"round({c}, 4) + 0.0 AS {c}" for c in money.split()]
    )


DAY = "(ts::DATE - DATE '1970-01-01')::BIGINT"
LAST_DAYS = "lastd AS (SELECT symbol, max(ts)::DATE + 2 AS last_day FROM bars GROUP BY symbol)"
GAPS = f"""{LAST_DAYS},
span AS (SELECT symbol, min(ts)::DATE AS f, max(ts)::DATE + 2 AS l FROM bars GROUP BY symbol),
gaps AS (
  SELECT symbol, unnest(generate_series(f::TIMESTAMP, l::TIMESTAMP, INTERVAL 1 DAY))::DATE AS "day" FROM span
  EXCEPT SELECT symbol, ts::DATE FROM bars)"""
STATS = f"""rets AS (SELECT *, equity / prev_equity - 1 AS ret FROM curve),
inwin AS (SELECT r.*, "window", start FROM rets r JOIN wins ON ts >= start AND ts < "end"),
winstart AS (SELECT {RUN}, "window", arg_min(prev_equity, ts) AS se FROM inwin GROUP BY ALL),
dd AS (
  SELECT i.*, se, equity / greatest(se, max(equity) OVER (
           PARTITION BY {RUN}, "window" ORDER BY ts ROWS UNBOUNDED PRECEDING)) - 1 AS dd
  FROM inwin i JOIN winstart USING ({RUN}, "window")),
wstat AS (
  SELECT {RUN}, "window", any_value(se) AS se, arg_max(equity, ts) AS ee, stddev_samp(ret) AS sd,
         count(ret) AS n, least(0.0, min(dd)) AS mdd, avg((units <> 0)::INTEGER) AS exposure
  FROM dd GROUP BY ALL),
wtrip AS (
  SELECT {RUN}, "window",
         count(*) FILTER (exit_ts >= start AND exit_ts < "end") AS completed,
         count(*) FILTER ((entry_ts < start AND start <= exit_ts) OR (entry_ts < "end" AND "end" <= exit_ts)) AS crossing
  FROM trips CROSS JOIN wins WHERE exit_ts IS NOT NULL GROUP BY ALL)"""
TOTAL = f"""ev AS (SELECT *, equity / prev_equity - 1 AS ret FROM curve WHERE ts >= {START} AND ts < {END}),
evs AS (SELECT {RUN}, arg_min(prev_equity, ts) AS se FROM ev GROUP BY ALL),
evd AS (
  SELECT ev.*, se, equity / greatest(se, max(equity) OVER (PARTITION BY {RUN} ORDER BY ts ROWS UNBOUNDED PRECEDING)) - 1 AS dd
  FROM ev JOIN evs USING ({RUN})),
tot AS (
  SELECT {RUN}, any_value(se) AS start_equity, arg_max(equity, ts) AS end_equity, stddev_samp(ret) AS sd, avg(ret) AS mu,
         count(ret) AS n, least(0.0, min(dd)) AS mdd, avg((units <> 0)::INTEGER) AS ex FROM evd GROUP BY ALL),
elig AS (SELECT * FROM trips WHERE entry_ts >= {START} AND exit_ts < {END}),
q AS (
  SELECT {RUN}, count(*) AS trips, count(*) FILTER (realized_pnl > 0) AS wins_,
         coalesce(sum(realized_pnl) FILTER (realized_pnl > 0), 0) AS gp,
         coalesce(-sum(realized_pnl) FILTER (realized_pnl < 0), 0) AS gl FROM elig GROUP BY ALL),
bi AS (SELECT {RUN}, count(*) AS burn FROM trips WHERE entry_ts < {START} AND exit_ts >= {START} GROUP BY ALL),
op AS (SELECT {RUN}, count(*) AS open_ FROM trips WHERE exit_ts IS NULL GROUP BY ALL)"""
ELIGIBLE = f"elig AS (SELECT * FROM trips WHERE entry_ts >= {START} AND exit_ts < {END})"
FINAL = """last AS (
  SELECT symbol, fast, slow, scenario, arg_max(equity, ts) AS fe, count(*) FILTER (target <> prev_target AND target = 0) AS sells
  FROM curve GROUP BY ALL)"""
RECONCILED = f"""SELECT {RUN}, sells AS left_trades, sells AS right_trades, 0::BIGINT AS date_mismatches,
  0::BIGINT AS price_mismatches, round(fe, 4) AS left_final_equity, round(fe, 4) AS right_final_equity,
  round(fe / {INITIAL_CASH} - 1, 8) AS left_total_return, round(fe / {INITIAL_CASH} - 1, 8) AS right_total_return,
  true AS equity_agrees, true AS return_agrees FROM last"""
DOC_RULES = """SELECT product, page_no, 'schema_version' AS rule FROM pages_ WHERE page_no = 1
  UNION ALL SELECT product, page_no, 'request_product' FROM pages_ WHERE page_no = 2
  UNION ALL SELECT product, page_no, 'request_text' FROM pages_ WHERE page_no = 3
  UNION ALL SELECT product, page_no, 'granularity' FROM pages_ WHERE page_no = 4
  UNION ALL SELECT product, page_no, 'artifact_keys' FROM pages_ WHERE page_no = 5
  UNION ALL SELECT product, page_no, 'retrieval_time' FROM pages_ WHERE page_no = 6
  UNION ALL SELECT product, page_no, 'rate_limit_headers' FROM pages_ WHERE page_no = 7
  UNION ALL SELECT product, page_no, 'not_json' FROM pages_ WHERE page_no = 0 AND product = 'A'"""
FAULTY_BARS = f"""src AS (SELECT *, {DAY} AS d, symbol::INTEGER AS n FROM bars),
fb AS (
  SELECT symbol, ts, CASE WHEN n % 4 = 0 THEN 40000 - d ELSE d END AS seq,
         CASE WHEN d % 103 = 0 AND n % 5 = 0 THEN NULL ELSE open END AS open,
         CASE WHEN d % 107 = 0 AND n % 2 = 0 THEN low - 1 ELSE high END AS high,
         CASE WHEN d % 109 = 0 AND n % 2 = 1 THEN -1.0 ELSE low END AS low,
         CASE WHEN d % 113 = 0 AND n % 7 = 0 THEN 'inf'::DOUBLE ELSE close END AS close,
         CASE WHEN d % 127 = 0 THEN -5.0 ELSE volume END AS volume, n,
         unnest(CASE WHEN d % 101 = 0 AND n % 3 = 0 THEN [0, 1] ELSE [0] END) AS copy
  FROM src)"""

ORACLES = {
    "scan_bars": f"""WITH {bars("lpad(l_linenumber::VARCHAR, 5, '0')")} SELECT symbol, ts, open, high, low, close, volume FROM bars""",
    "research_rows": """SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM lineitem
        WHERE l_shipdate < TIMESTAMP '2001-01-01'""",
    "research_lineage": f"""{BARS} SELECT symbol, 'research_snapshot' AS kind, 1 AS schema_version,
        'parent' AS source_processed_sha256, 'ts < 2001-01-01' AS derivation_predicate,
        '2001-01-01' AS research_half_open_end, count(*) AS row_count,
        strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS first_timestamp,
        strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last_timestamp
        FROM bars WHERE ts < TIMESTAMP '2001-01-01' GROUP BY symbol""",
    "snapshot_metadata": f"""{SUPPLIER_BARS} SELECT symbol, '1d' AS "interval", count(*) AS row_count,
        strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS first_timestamp,
        strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last_timestamp,
        'symbol,ts,open,high,low,close,volume' AS columns FROM bars GROUP BY symbol""",
    "flatten_pages": f"""{BARS}, {RAW}, {PAGES} SELECT pg.product, pg.page_no,
        (req_d * 86400)::VARCHAR AS request_start, (end_d * 86400)::VARCHAR AS request_end,
        (row_number() OVER (PARTITION BY pg.product, pg.page_no ORDER BY d DESC) - 1)::INTEGER AS pos,
        start, low, high, open, close, volume
        FROM pg JOIN pages_ p ON p.product = pg.product AND p.page_no = pg.page_no""",
    "artifact_counts": f"""{BARS}, {RAW}, {PAGES} SELECT product, count(*) AS page_count,
        sum(n)::BIGINT AS candle_count FROM pages_ GROUP BY product""",
    "page_schema_violations": f"""{BARS}, {RAW}, {PAGES}
        {DOC_RULES}""",
    "registry_scan": f"""WITH {REGISTRY}, {JUDGED} SELECT {registry_columns()} FROM rec
        WHERE experiment_id NOT IN (SELECT experiment_id FROM broken)""",
    "latest_artifact": f"""WITH {CATALOG} SELECT symbol, '1d' AS "interval",
        CASE WHEN bad = 0 THEN path END AS path, CASE WHEN bad = 0 THEN created_at END AS created_at,
        artifacts, CASE WHEN bad = 0 THEN 'ok' ELSE 'invalid_metadata' END AS status
        FROM (SELECT recorded AS symbol, path, created_at, count(*) OVER g AS artifacts,
                     count(*) FILTER (created_at IS NULL) OVER g AS bad,
                     row_number() OVER (PARTITION BY recorded ORDER BY created_at DESC NULLS LAST, path) AS rn
              FROM proc WINDOW g AS (PARTITION BY recorded)) WHERE rn = 1""",
    "lineage_join": f"""WITH {CATALOG} SELECT p.source_raw_sha256, p.path, p.recorded AS symbol,
               CASE WHEN r.raw_sha = p.source_raw_sha256 THEN r.path END AS raw_path,
               CASE WHEN r.path IS NULL THEN 'raw_missing' WHEN r.raw_sha = p.source_raw_sha256 THEN 'ok' ELSE 'hash_differs' END AS status
        FROM proc p LEFT JOIN raw r ON r.path = 'raw/' || CASE WHEN p.o_orderkey % 31 = 0 THEN 'moved' ELSE p.symbol END || '/1d/' || p.key || '.parquet'""",
    "identity_violations": f"""WITH {CATALOG} SELECT path,
        CASE WHEN o_orderkey % 23 = 0 THEN 'identity_differs_from_path' ELSE 'file_differs_from_path' END AS rule
        FROM proc WHERE o_orderkey % 23 = 0 OR o_orderkey % 29 = 0""",
    "new_artifacts": f"""WITH {CATALOG}, everything AS (SELECT path, written_at FROM raw UNION ALL SELECT path, written_at FROM proc)
        SELECT path FROM everything WHERE written_at IS NULL OR written_at >= TIMESTAMP '2000-01-01'""",
    "registry_violations": f"WITH {REGISTRY}, {JUDGED} SELECT experiment_id, rule FROM broken",
    "registry_migrate": f"WITH {REGISTRY} SELECT {migrated_columns()} FROM rec",
    "canonical_bars": """SELECT l_returnflag AS symbol, l_shipdate AS ts, l_extendedprice AS open,
        l_extendedprice AS high, l_discount AS low, l_tax AS close, l_quantity AS volume FROM lineitem""",
    "ohlcv_violations": f"""{SUPPLIER_BARS}, {FAULTY_BARS},
        ord AS (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY seq) AS before FROM fb)
        SELECT symbol, 'duplicate_ts' AS rule, (count(*) - count(DISTINCT ts))::BIGINT AS "rows" FROM fb GROUP BY symbol HAVING "rows" > 0
        UNION ALL SELECT symbol, 'missing_value', count(*) FROM fb WHERE open IS NULL GROUP BY symbol
        UNION ALL SELECT symbol, 'infinite_value', count(*) FROM fb WHERE isinf(close) GROUP BY symbol
        UNION ALL SELECT symbol, 'non_positive_price', count(*) FROM fb WHERE open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 GROUP BY symbol
        UNION ALL SELECT symbol, 'negative_volume', count(*) FROM fb WHERE volume < 0 GROUP BY symbol
        UNION ALL SELECT symbol, 'high_below_bar', count(*) FROM fb WHERE high < greatest(open, close, low) GROUP BY symbol
        UNION ALL SELECT symbol, 'low_above_bar', count(*) FROM fb WHERE low > least(open, close, high) GROUP BY symbol
        UNION ALL SELECT symbol, 'not_ascending', 1::BIGINT FROM ord WHERE ts < before GROUP BY symbol""",
    "corporate_actions": f"""{SUPPLIER_BARS}, src AS (SELECT *, {DAY} AS d, symbol::INTEGER AS n FROM bars),
        act AS (SELECT symbol, ts, (n % 9 = 0 AND d % 50 = 0) OR (n % 10 = 0 AND d % 60 = 0) AS split, d % 63 = 0 AS paid
                FROM src), rng AS (SELECT *, {ALLOWED} AS inside FROM act)
        SELECT symbol, count(*) FILTER (inside AND split) AS split_events,
               count(*) FILTER (inside AND paid) AS dividend_events,
               min(ts) FILTER (inside AND paid) AS first_dividend, max(ts) FILTER (inside AND paid) AS last_dividend,
               CASE WHEN count(*) FILTER (inside AND split) = 0 THEN 'ok' ELSE 'unsupported_split' END AS status
        FROM rng GROUP BY symbol""",
    "gap_metadata_violations": f"""{SUPPLIER_BARS}, {GAPS},
        l AS (SELECT symbol, symbol::INTEGER AS n, count("day") AS days
              FROM (SELECT DISTINCT symbol FROM bars) LEFT JOIN gaps USING (symbol) GROUP BY symbol),
        m AS (SELECT *, n % 11 <> 0 AS p, n % 7 <> 0 AS listed FROM l)
        SELECT symbol, 'field_without_provider' AS rule FROM m WHERE NOT p
        UNION ALL SELECT symbol, 'required_field_missing' FROM m WHERE p AND NOT listed
        UNION ALL SELECT symbol, 'bad_date' FROM m WHERE p AND listed AND n % 5 = 1
        UNION ALL SELECT symbol, 'duplicate_date' FROM m WHERE p AND listed AND n % 5 = 2 AND days > 0
        UNION ALL SELECT symbol, 'not_ascending' FROM m WHERE p AND listed AND
            ((n % 5 = 2 AND days > 1) OR (n % 5 = 3 AND days > 1) OR n % 5 = 1)
            AND NOT (n % 5 = 1 AND (SELECT max("day")::VARCHAR FROM gaps g WHERE g.symbol = m.symbol) < '1999-1-2')
        UNION ALL SELECT symbol, 'count_mismatch' FROM m WHERE p AND listed AND n % 13 = 0
        UNION ALL SELECT symbol, 'blank_unit_text' FROM m WHERE p AND n % 3 = 0""",
    "split_rows": f"""{BARS} SELECT symbol, ts, close, CASE WHEN ts < TIMESTAMP '1999-01-01' THEN 'train'
        WHEN ts < TIMESTAMP '2001-01-01' THEN 'validation' ELSE 'test' END AS split FROM bars
        WHERE ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '2002-01-01'""",
    "split_label": """SELECT o_orderkey, o_orderdate AS ts,
        CASE WHEN o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' THEN 'train'
             WHEN o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderdate < TIMESTAMP '2001-01-01' THEN 'validation' END AS split
        FROM orders""",
    "research_filter": f"{BARS} SELECT * FROM bars WHERE {ALLOWED}",
    "split_violations": f"""{SUPPLIER_BARS},
        s AS (SELECT symbol, symbol::INTEGER AS n, min(ts)::DATE AS a, max(ts)::DATE AS z FROM bars GROUP BY symbol),
        t AS (SELECT *, a + 1000 AS c1, a + 1600 AS c2,
                     a + 1000 + CASE WHEN n % 4 = 1 THEN 5 WHEN n % 4 = 2 THEN -5 ELSE 0 END AS late,
                     CASE WHEN n % 6 = 0 THEN a + 1600 ELSE z END AS e FROM s),
        parts AS (SELECT symbol, 0 AS position, 'train' AS name, a AS b, c1 AS e FROM t
                  UNION ALL SELECT symbol, 1, 'validation', late, c2 FROM t
                  UNION ALL SELECT symbol, 2, 'test', c2, e FROM t),
        p AS (SELECT *, lag(e) OVER (PARTITION BY symbol ORDER BY position) AS pe FROM parts)
        SELECT symbol, position, name, 'start_not_before_end' AS rule FROM p WHERE NOT b < e
        UNION ALL SELECT symbol, position, name, 'overlap_or_disorder' FROM p WHERE pe > b
        UNION ALL SELECT symbol, position, name, 'gap' FROM p WHERE pe < b""",
    "completed_buckets": """SELECT l_orderkey, l_linenumber, l_shipdate AS ts FROM lineitem
        WHERE l_shipdate + INTERVAL 1 DAY <= TIMESTAMP '2000-06-15 13:30:00'""",
    "evaluation_windows": """SELECT symbol, y::INTEGER AS "window", make_timestamp(y, 1, 1, 0, 0, 0) AS start,
        make_timestamp(y + 1, 1, 1, 0, 0, 0) AS "end", y = lo AS burn_in
        FROM (SELECT symbol, lo, unnest(range(lo, hi + 1)) AS y FROM
              (SELECT l_suppkey::VARCHAR AS symbol, year(min(l_shipdate)) AS lo, year(max(l_shipdate)) AS hi
               FROM lineitem GROUP BY 1))""",
    "window_rows": f"""{BARS}, {WINDOWS_CTE} SELECT symbol, ts, close, "window" FROM bars
        JOIN wins ON ts >= start AND ts < "end" """,
    "plan_windows": f"""{SUPPLIER_BARS}, {PLAN} SELECT symbol, page_no, first_day, last_day,
        (last_day - first_day + 1)::INTEGER AS day_count,
        ((first_day - DATE '1970-01-01')::BIGINT * 86400)::VARCHAR AS request_start,
        ((last_day - DATE '1970-01-01')::BIGINT * 86400)::VARCHAR AS request_end, 'ok' AS status FROM planned""",
    "calendar_gaps": f"""{SUPPLIER_BARS}, {GAPS} SELECT symbol, "day" FROM gaps""",
    "history_summary": f"""{SUPPLIER_BARS}, {GAPS},
        g AS (SELECT symbol, string_agg("day"::VARCHAR, ',' ORDER BY "day") AS days, count(*) AS n FROM gaps GROUP BY symbol)
        SELECT symbol, min(ts) AS earliest, max(ts) AS latest, count(*) AS candle_count,
               coalesce(any_value(days), '') AS missing_days, coalesce(any_value(n), 0) AS missing_day_count
        FROM bars LEFT JOIN g USING (symbol) GROUP BY symbol""",
    "decode_candles": f"""{BARS}, {FAULTY} SELECT product, page_no::INTEGER AS page_no, make_timestamp(d * 86400000000) AS ts,
        {', '.join(f'{plain_decimal(c)} AS {c}' for c in ('open', 'high', 'low', 'close', 'volume'))}
        FROM judged WHERE reject IS NULL""",
    "decode_rejects": f"""{BARS}, {FAULTY} SELECT product, page_no::INTEGER AS page_no, pos::INTEGER AS pos, start, reject
        FROM judged WHERE reject IS NOT NULL
        UNION ALL SELECT DISTINCT l_linestatus, NULL::INTEGER, NULL::INTEGER, NULL, 'empty_history' FROM lineitem
        WHERE l_linestatus NOT IN (SELECT l_returnflag FROM lineitem)""",
    "canonical_from_pages": f"""{BARS}, {FAULTY} SELECT product AS symbol, make_timestamp(d * 86400000000) AS ts,
        open::DOUBLE AS open, high::DOUBLE AS high, low::DOUBLE AS low, close::DOUBLE AS close,
        volume::DOUBLE AS volume FROM judged WHERE reject IS NULL""",
    "page_profile": f"""{BARS}, {RAW}, {PAGES},
        have AS (SELECT p.product, p.page_no, count(*) FILTER (pg.d >= req_d AND pg.d < end_d) AS inside, max(pg.d) AS newest
                 FROM pages_ p JOIN pg ON pg.product = p.product AND pg.page_no = p.page_no GROUP BY ALL)
        SELECT product, page_no, n AS returned, n AS parseable,
               CASE WHEN n < 2 THEN 'single_or_empty' ELSE 'descending' END AS ordering, 0::BIGINT AS off_midnight,
               greatest(end_d - req_d, 0)::BIGINT AS requested_days,
               (greatest(end_d - req_d, 0) - inside)::BIGINT AS missing_days, newest = last_d AS newest_is_run_day
        FROM pages_ JOIN have USING (product, page_no)""",
    "page_plan_mismatch": f"""{BARS}, {RAW}, {PAGES}, {PLAN},
        a AS (SELECT product, page_no, (req_d * 86400)::VARCHAR AS found_start, (end_d * 86400)::VARCHAR AS found_end FROM pages_),
        b AS (SELECT symbol AS product, page_no, ((first_day - DATE '1970-01-01')::BIGINT * 86400)::VARCHAR AS expected_start,
                     ((last_day - DATE '1970-01-01')::BIGINT * 86400)::VARCHAR AS expected_end FROM planned)
        SELECT product, page_no, found_start, found_end, expected_start, expected_end,
               CASE WHEN found_start IS NULL THEN 'page_missing' WHEN expected_start IS NULL THEN 'page_unplanned'
                    ELSE 'window_mismatch' END AS reason
        FROM a FULL OUTER JOIN b USING (product, page_no)
        WHERE found_start IS DISTINCT FROM expected_start OR found_end IS DISTINCT FROM expected_end""",
    "revision_diff": f"""{BARS}, {SNAPSHOTS} SELECT product, "day", age::INTEGER AS age_days, bucket, kind,
        CASE WHEN kind IN ('value', 'format_only') THEN 'close' END AS field,
        CASE kind WHEN 'audit_only' THEN NULL WHEN 'baseline_only' THEN bj ELSE bc END AS old,
        CASE kind WHEN 'audit_only' THEN aj WHEN 'baseline_only' THEN NULL ELSE ac END AS new
        FROM kinds WHERE kind IS NOT NULL""",
    "revision_counts": f"""{BARS}, {SNAPSHOTS},
        first AS (SELECT product, min("day") AS f, any_value(ref) AS ref FROM pairs JOIN refs USING (product) GROUP BY product),
        cal AS (SELECT product, unnest(range(1, (ref - f) + 1)) AS age FROM first),
        calb AS (SELECT product, CASE WHEN age = 1 THEN '1' WHEN age <= 7 THEN '2-7' WHEN age <= 30 THEN '8-30' ELSE '>30' END AS bucket FROM cal),
        allrows AS (
          SELECT product, bucket, 1 AS ev, NULL AS bd, NULL AS ad, NULL AS kind, false AS isday FROM calb
          UNION ALL SELECT product, bucket, 0, bd, ad, kind, true FROM kinds
          UNION ALL SELECT product, b, 0, NULL, NULL, NULL, false FROM first CROSS JOIN (VALUES ('1'), ('2-7'), ('8-30'), ('>30')) v(b))
        SELECT product, coalesce(bucket, 'total') AS bucket, sum(ev)::BIGINT AS days_evaluated,
               count(*) FILTER (bd IS NOT NULL AND ad IS NOT NULL) AS matched_days,
               count(*) FILTER (bd IS NOT NULL AND ad IS NOT NULL AND kind IS NULL) AS identical_days,
               count(*) FILTER (kind IS NOT NULL) AS differing_days,
               count(*) FILTER (kind IS NOT NULL AND kind <> 'format_only') AS semantic_differing_days,
               count(*) FILTER (kind = 'value') AS value_records, count(*) FILTER (kind = 'format_only') AS format_only_records,
               count(*) FILTER (kind = 'baseline_only') AS baseline_only_records,
               count(*) FILTER (kind = 'audit_only') AS audit_only_records
        FROM allrows GROUP BY GROUPING SETS ((product, bucket), (product))""",
    "revision_verdict": f"""{BARS}, {SNAPSHOTS},
        v AS (SELECT product, max(age) FILTER (kind <> 'format_only') AS oldest, count(kind) AS diffs,
                     count(*) FILTER (kind = 'format_only') AS drift FROM kinds GROUP BY product),
        late AS (SELECT product, count(*) AS n FROM aud JOIN refs USING (product) WHERE "day" >= ref GROUP BY product)
        SELECT product, CASE WHEN oldest IS NULL AND diffs = 0 THEN 'PASS' WHEN oldest IS NULL THEN 'PASS_WITH_FORMAT_DRIFT'
               WHEN oldest >= 8 THEN 'STOP' WHEN oldest >= 2 THEN 'PASS_WITH_7D_EMBARGO' ELSE 'PASS_WITH_1D_EMBARGO' END AS verdict,
               drift = 0 AS raw_representation_stable, coalesce(n, 0) AS audit_days_after_baseline
        FROM v LEFT JOIN late USING (product)""",
    "bars_from_ticks": """SELECT event_type AS symbol, date_trunc('day', ts)::TIMESTAMP AS ts,
        arg_min(value, {'t': ts, 'i': event_id}) AS open, max(value) AS high, min(value) AS low,
        arg_max(value, {'t': ts, 'i': event_id}) AS close, count(*)::DOUBLE AS volume
        FROM events GROUP BY 1, 2""",
    "ema": f"""WITH RECURSIVE {bars()}, {averages([10, 30])} SELECT symbol, ts, close,
        CASE WHEN idx >= 9 THEN round(e10, 8) END AS ema_10, CASE WHEN idx >= 29 THEN round(e30, 8) END AS ema_30
        FROM num JOIN ema USING (symbol, idx)""",
    "crossover_signal": f"""WITH RECURSIVE {bars()}, {averages([10, 30])} SELECT symbol, ts,
        CASE WHEN idx >= 9 THEN round(e10, 8) END AS fast_ema, CASE WHEN idx >= 29 THEN round(e30, 8) END AS slow_ema,
        CASE WHEN idx >= 29 AND e10 > e30 THEN 1 ELSE 0 END AS signal FROM num JOIN ema USING (symbol, idx)""",
    "target_position": f"{ONE} SELECT symbol, ts, fast, slow, signal, target, prev_target FROM st",
    "entry_exit_events": f"""{ONE} SELECT symbol, ts, signal = 1 AND target = 0 AS entry, signal = 0 AND target = 1 AS exit,
        target = 1 AND prev_target = 0 AS fill_entry, target = 0 AND prev_target = 1 AS fill_exit FROM st""",
    "signal_transitions": f"""{study(symbol='l_suppkey', research=False)}
        SELECT symbol, count(*) FILTER (idx > 0 AND signal <> target) AS transitions FROM st GROUP BY symbol""",
    "fill_ledger": f"""{ONE} SELECT {RUN}, ts, side, price, {rounded('quantity')},
        round(CASE WHEN side = 'buy' THEN amount ELSE 0 END, 8) AS units_after,
        round(quantity * price * c, 4) AS commission, round(CASE WHEN side = 'buy' THEN 0 ELSE amount END, 4) AS cash_after
        FROM fills""",
    "equity_curve": f"{ONE} SELECT {RUN}, ts, {rounded('units', 'cash position_value equity')} FROM curve",
    "drawdown_curve": f"""{ONE}, pk AS (SELECT *, max(equity) OVER (PARTITION BY {RUN} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM curve)
        SELECT {RUN}, ts, round(equity / peak - 1, 8) + 0.0 AS drawdown, {rounded('', 'equity peak')} FROM pk""",
    "daily_returns": f"""{ONE} SELECT {RUN}, ts, round(equity / prev_equity - 1, 8) + 0.0 AS ret FROM curve
        WHERE prev_equity IS NOT NULL""",
    "equity_before": f"""{ONE}, bounds AS (SELECT start AS boundary FROM wins UNION SELECT "end" FROM wins)
        SELECT {RUN}, boundary, max(ts) AS ts, round(arg_max(equity, ts), 4) AS equity, 'ok' AS status
        FROM curve JOIN bounds ON ts < boundary GROUP BY {RUN}, boundary""",
    "round_trips": f"""{ONE} SELECT {RUN}, trip, entry_ts, exit_ts, entry_price, exit_price, {rounded('quantity', 'entry_commission exit_commission realized_pnl')}
        FROM trips WHERE exit_ts IS NOT NULL""",
    "eligible_round_trips": f"""{ONE} SELECT {RUN}, entry_ts, exit_ts, round(realized_pnl, 4) AS realized_pnl FROM trips
        WHERE entry_ts >= {START} AND exit_ts < {END}""",
    "burn_in_round_trips": f"""{study(GRID)} SELECT {RUN}, entry_ts, exit_ts, round(realized_pnl, 4) AS realized_pnl FROM trips
        WHERE entry_ts < {START} AND exit_ts >= {START}""",
    "cross_boundary": f"""{ONE} SELECT {RUN}, entry_ts, exit_ts, "window", start, "end", true AS crosses FROM trips CROSS JOIN wins
        WHERE (entry_ts < start AND start <= exit_ts) OR (entry_ts < "end" AND "end" <= exit_ts)""",
    "buy_and_hold": f"""{SUPPLIER_BARS}, r AS (SELECT * FROM bars WHERE {ALLOWED}),
        p AS (SELECT symbol, min(ts) FILTER (ts >= {START}) AS entry_ts, arg_min(open, ts) FILTER (ts >= {START}) AS entry_open,
                     max(ts) FILTER (ts < {END}) AS final_ts, arg_max(close, ts) FILTER (ts < {END}) AS final_close FROM r GROUP BY symbol),
        s AS (SELECT *, CASE WHEN entry_ts IS NULL THEN 'no_rows_from_start' WHEN final_ts IS NULL THEN 'no_rows_before_end'
                     WHEN final_ts < entry_ts THEN 'end_precedes_start' ELSE 'ok' END AS status FROM p),
        x AS (SELECT *, CASE WHEN status = 'ok' THEN entry_open * (1 + 0.0005) END AS ep FROM s),
        q AS (SELECT *, {INITIAL_CASH} / (ep * (1 + 0.001)) AS qty FROM x)
        SELECT symbol, entry_ts, round(entry_open, 8) AS entry_open, final_ts, round(final_close, 8) AS final_close, status,
               round(ep, 8) AS entry_price, round(qty, 8) AS quantity, round(qty * ep * 0.001, 4) AS entry_commission,
               round(qty * final_close, 4) AS final_value, round(qty * final_close / {INITIAL_CASH} - 1, 8) AS total_return FROM q""",
    "curve_metrics": f"""{ONE}, pk AS (SELECT *, equity / max(equity) OVER (PARTITION BY {RUN} ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM curve)
        SELECT {RUN}, round(arg_max(equity, ts) / arg_min(equity, ts) - 1, 8) AS total_return, round(min(dd), 8) AS max_drawdown,
               count(*) FILTER (target <> prev_target AND target = 0) AS num_completed_trades FROM pk GROUP BY {RUN}""",
    "window_metrics": f"""{ONE}, {STATS} SELECT {RUN}, "window", round(se, 4) AS start_equity, round(ee, 4) AS end_equity,
        round(ee / se - 1, 8) AS total_return, round(CASE WHEN n >= 2 THEN sd * sqrt(252) END, 8) AS volatility,
        CASE WHEN n >= 2 THEN 'ok' ELSE 'insufficient_sample' END AS volatility_status, {gate('volatility', 'n', 2)}, round(mdd, 8) AS local_max_drawdown,
        round(exposure, 8) AS exposure, coalesce(completed, 0) AS completed_trips, coalesce(crossing, 0) AS cross_boundary_trips,
        'ok' AS status FROM wstat LEFT JOIN wtrip USING ({RUN}, "window")""",
    "aggregate_metrics": f"""{ONE}, {TOTAL} SELECT {RUN}, round(start_equity, 4) AS start_equity, round(end_equity, 4) AS end_equity,
        round(pow(end_equity / start_equity, 1.0 / 5) - 1, 8) AS cagr, round(sd * sqrt(252), 8) AS volatility, 'ok' AS volatility_status,
        {gate('volatility', 'n', 2)}, {gate('hit_rate', 'trips', 20)}, {gate('profit_factor', 'trips', 20)}, {gate('sharpe_like', 'n', 60)},
        'ok' AS cagr_status, round(mdd, 8) AS max_drawdown, round(ex, 8) AS exposure, coalesce(trips, 0) AS eligible_trips,
        round(CASE WHEN trips >= 20 THEN wins_ / trips END, 8) AS hit_rate,
        CASE WHEN trips >= 20 THEN 'ok' ELSE 'insufficient_sample' END AS hit_rate_status,
        round(CASE WHEN trips >= 20 AND gl > 0 THEN gp / gl END, 8) AS profit_factor,
        CASE WHEN trips >= 20 THEN CASE WHEN gl = 0 THEN 'not_applicable' ELSE 'ok' END ELSE 'insufficient_sample' END AS profit_factor_status,
        round(CASE WHEN n >= 60 THEN mu / sd * sqrt(252) END, 8) AS sharpe_like,
        CASE WHEN n < 60 THEN 'insufficient_sample' WHEN sd = 0 THEN 'not_applicable' ELSE 'ok' END AS sharpe_like_status,
        coalesce(burn, 0) AS burn_in_trips, coalesce(open_, 0) > 0 AS still_open_at_end
        FROM tot LEFT JOIN q USING ({RUN}) LEFT JOIN bi USING ({RUN}) LEFT JOIN op USING ({RUN})""",
    "trip_quality": f"""{study(GRID)}, {TOTAL} SELECT {RUN}, trips, {gate('hit_rate', 'trips', 20)}, {gate('profit_factor', 'trips', 20)},
        round(CASE WHEN trips >= 20 THEN wins_ / trips END, 8) AS hit_rate,
        CASE WHEN trips >= 20 THEN 'ok' ELSE 'insufficient_sample' END AS hit_rate_status,
        round(CASE WHEN trips >= 20 AND gl > 0 THEN gp / gl END, 8) AS profit_factor,
        CASE WHEN trips >= 20 THEN CASE WHEN gl = 0 THEN 'not_applicable' ELSE 'ok' END ELSE 'insufficient_sample' END AS profit_factor_status
        FROM q""",
    "pnl_concentration": f"""{study(GRID)}, {ELIGIBLE},
        pos AS (SELECT *, sum(realized_pnl) OVER (PARTITION BY {RUN} ORDER BY realized_pnl DESC ROWS UNBOUNDED PRECEDING) AS cum,
                       row_number() OVER (PARTITION BY {RUN} ORDER BY realized_pnl DESC) AS rk,
                       sum(realized_pnl) OVER (PARTITION BY {RUN}) AS tot FROM elig WHERE realized_pnl > 0),
        res AS (SELECT {RUN}, max(realized_pnl) / any_value(tot) AS frac, min(rk) FILTER (cum >= 0.5 * tot) AS k, any_value(tot) AS tot FROM pos GROUP BY ALL)
        SELECT {RUN}, round(frac, 8) AS largest_positive_fraction, k AS trips_for_half, round(coalesce(tot, 0), 4) AS total_positive_pnl,
               CASE WHEN frac IS NULL THEN 'no positive round trips' END AS note
        FROM (SELECT DISTINCT {RUN} FROM elig) LEFT JOIN res USING ({RUN})""",
    "largest_move": f"""{SUPPLIER_BARS}, c AS (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS change FROM bars),
        r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(change) DESC, ts) AS rn FROM c WHERE change IS NOT NULL)
        SELECT symbol, ts, round(change, 8) AS change FROM r WHERE rn = 1""",
    "grid_returns_by_part": f"""{study(SPOT_CHECKS, symbol='l_partkey')}, {RETURNS} SELECT {RUN}, {WINDOW_COLUMNS} FROM ret JOIN agg USING ({RUN})""",
    "grid_returns": f"""{GRID_STUDY} SELECT {RUN}, {WINDOW_COLUMNS}
        FROM ret JOIN agg USING ({RUN})""",
    "window_returns": f"""{ONE}, {RETURNS} SELECT {RUN}, "window", round(r, 8) AS window_return,
        round(start_equity, 4) AS start_equity, round(end_equity, 4) AS end_equity, 'ok' AS status FROM ret""",
    "cost_stress": f"""{study(costs=COST_SCENARIOS)}, {RETURNS} SELECT {RUN}, {WINDOW_COLUMNS} FROM ret JOIN agg USING ({RUN})""",
    "leave_one_out": f"""{GRID_STUDY},
        loo AS (SELECT x.symbol, x.fast, x.slow, x.scenario, x."window", product(1 + y.r) - 1 AS without
                FROM ret x JOIN ret y ON x.symbol = y.symbol AND x.fast = y.fast AND x.slow = y.slow
                 AND x.scenario = y.scenario AND x."window" <> y."window" GROUP BY ALL)
        SELECT {RUN}, round(a, 8) AS full_aggregate, round(max(abs(without - a)) OVER (PARTITION BY {RUN}), 8) AS largest_change,
               "window", round(without, 8) AS without, (without >= 0) <> (a >= 0) AS sign_flip, 'ok' AS status
        FROM loo JOIN agg USING ({RUN})""",
    "window_dispersion": f"""{GRID_STUDY} SELECT symbol, "window", round(min(r), 8) AS min_return, round(median(r), 8) AS median_return,
        round(max(r), 8) AS max_return FROM ret GROUP BY symbol, "window" """,
    "grid_neighbors": f"""{GRID_PAIRS} SELECT symbol, fast, slow, fi::INTEGER AS fi, si::INTEGER AS si, nfi::INTEGER AS nfi, nsi::INTEGER AS nsi,
        round(a, 8) AS aggregate_return, n_fast, n_slow, round(b, 8) AS n_return FROM nb""",
    "sign_consistency": f"""{GRID_PAIRS} SELECT symbol, count(*) AS pairs, count(*) FILTER ((a >= 0) = (b >= 0)) AS matching,
        round(count(*) FILTER ((a >= 0) = (b >= 0)) / count(*), 8) AS sign_consistency
        FROM nb WHERE (fi, si) < (nfi, nsi) GROUP BY symbol""",
    "sign_flip_pairs": f"""{GRID_PAIRS} SELECT symbol, fast, slow, n_fast, n_slow FROM nb
        WHERE (fi, si) < (nfi, nsi) AND (a >= 0) <> (b >= 0)""",
    "baseline_neighbors": f"""{GRID_PAIRS} SELECT symbol, round(a, 8) AS baseline_return, n_fast, n_slow, round(b, 8) AS n_return
        FROM nb WHERE fast = 10 AND slow = 30""",
    "isolated_cells": f"""{GRID_PAIRS}, m AS (SELECT symbol, avg(abs(a - b)) AS g FROM nb GROUP BY symbol),
        c AS (SELECT symbol, fast, slow, any_value(a) AS a, avg(b) AS mean FROM nb GROUP BY ALL)
        SELECT symbol, fast, slow, round(mean, 8) AS neighbor_mean, round(abs(a - mean), 8) AS difference,
               round(2 * g, 8) AS threshold, abs(a - mean) > 2 * g AS isolated FROM c JOIN m USING (symbol)""",
    "ledger_reconcile": f"{study(GRID)}, {FINAL} {RECONCILED}",
    "spot_checks": f"{study(SPOT_CHECKS)}, {FINAL} {RECONCILED}",
    "partition_report": f"""WITH RECURSIVE {bars()},
        research AS (SELECT *, CASE WHEN ts < TIMESTAMP '1999-01-01' THEN 'train' ELSE 'validation' END AS split FROM bars WHERE {ALLOWED}),
        {averages([10, 30], 'research', 'symbol, split')}, {states([BASELINE_CELL], 'symbol, split')}, {book(BASELINE, 'symbol, split')}
        SELECT symbol, split, count(*) FILTER (target <> prev_target AND target = 0) AS trades,
               round(arg_max(equity, ts), 4) AS final_equity, round(arg_max(equity, ts) / {INITIAL_CASH} - 1, 8) AS total_return
        FROM curve GROUP BY symbol, split""",
}

assert w.RESEARCH_CUTOFF == "2001-01-01"


def _again(name: str, symbol: str, base: str = "l_returnflag", old: str = "", new: str = "") -> str:
    """The check of another query over another choice of symbols."""
    sql = ORACLES[name]
    assert base in sql
    return sql.replace(f"{base}::VARCHAR AS symbol", f"{symbol}::VARCHAR AS symbol").replace(old or "\0", new)


ORACLES |= {
    f"{name}_by_supplier": _again(name, "l_suppkey")
    for name in ("fill_ledger", "drawdown_curve", "round_trips", "window_metrics")
}
ORACLES["ema_intraday"] = f"""WITH RECURSIVE ticks AS (SELECT event_type AS symbol, ts, value AS close FROM events),
  {averages([10, 30], 'ticks')} SELECT symbol, ts, close, round(CASE WHEN idx >= 9 THEN e10 END, 8) AS ema_10,
  round(CASE WHEN idx >= 29 THEN e30 END, 8) AS ema_30 FROM num JOIN ema USING (symbol, idx)"""
DENSE = """ticks AS (
  SELECT event_type AS symbol, TIMESTAMP '2024-01-01' + to_days(CASE WHEN event_id % 10 = 0 THEN event_id % 40 ELSE 0 END::INTEGER)
         + to_milliseconds(event_id) AS ts, value AS open, value AS close FROM events)"""
ORACLES["ema_dense_day"] = f"""WITH RECURSIVE {DENSE},
  {averages([10, 30], 'ticks')} SELECT symbol, ts, close, round(CASE WHEN idx >= 9 THEN e10 END, 8) AS ema_10,
  round(CASE WHEN idx >= 29 THEN e30 END, 8) AS ema_30 FROM num JOIN ema USING (symbol, idx)"""
ORACLES["target_position_dense_day"] = f"""WITH RECURSIVE {DENSE}, {averages(list(BASELINE_CELL), 'ticks')}, {states([BASELINE_CELL])}
  SELECT symbol, ts, fast, slow, signal, target::INTEGER AS target, prev_target::INTEGER AS prev_target FROM st"""
ORACLES["leave_one_out_by_part"] = f"""{study(symbol='l_partkey')}, {RETURNS},
  loo AS (SELECT {RUN}, x."window", product(1 + y.r) - 1 AS w FROM ret x JOIN ret y USING ({RUN})
          WHERE x."window" <> y."window" GROUP BY ALL)
  SELECT {RUN}, "window", round(a, 8) AS full_aggregate, round(CASE WHEN a IS NOT NULL THEN w END, 8) AS without,
         round(max(CASE WHEN a IS NOT NULL THEN abs(w - a) END) OVER (PARTITION BY {RUN}), 8) AS largest_change,
         CASE WHEN a IS NULL THEN 'missing_window' ELSE 'ok' END AS status,
         CASE WHEN a IS NOT NULL THEN (w >= 0) <> (a >= 0) END AS sign_flip
  FROM loo JOIN agg USING ({RUN})"""
_TOTAL_OF_ANY = TOTAL.replace("arg_min(prev_equity, ts) AS se", "arg_min_null(prev_equity, ts) AS se")
ORACLES["aggregate_metrics_by_part"] = f"""{study(symbol='l_partkey')}, {_TOTAL_OF_ANY}
  SELECT {RUN}, round(start_equity, 4) AS start_equity, round(end_equity, 4) AS end_equity,
         round(pow(end_equity / start_equity, 1.0 / 5) - 1, 8) AS cagr,
         CASE WHEN start_equity IS NULL THEN 'no_equity_before_start' ELSE 'ok' END AS cagr_status,
         round(CASE WHEN n >= 2 THEN sd * sqrt(252) END, 8) AS volatility,
         CASE WHEN n >= 2 THEN 'ok' ELSE 'insufficient_sample' END AS volatility_status,
         {gate('volatility', 'n', 2)}, {gate('hit_rate', 'trips', 20)}, {gate('profit_factor', 'trips', 20)}, {gate('sharpe_like', 'n', 60)},
         round(mdd, 8) AS max_drawdown, round(ex, 8) AS exposure, coalesce(trips, 0) AS eligible_trips,
         NULL::DOUBLE AS hit_rate, 'insufficient_sample' AS hit_rate_status, NULL::DOUBLE AS profit_factor,
         'insufficient_sample' AS profit_factor_status, NULL::DOUBLE AS sharpe_like,
         'insufficient_sample' AS sharpe_like_status, coalesce(burn, 0) AS burn_in_trips, coalesce(open_, 0) > 0 AS still_open_at_end
  FROM (SELECT DISTINCT {RUN} FROM curve) LEFT JOIN tot USING ({RUN}) LEFT JOIN q USING ({RUN}) LEFT JOIN bi USING ({RUN}) LEFT JOIN op USING ({RUN})"""
ORACLES["artifact_audit"] = """WITH f AS (
    SELECT page_id::VARCHAR AS path, strlen(html)::BIGINT AS length, sha256(html) AS sha256 FROM pages WHERE page_id % 17 <> 0),
  r AS (SELECT page_id::VARCHAR AS path, sha256(CASE WHEN page_id % 10 = 0 THEN html || ' ' ELSE html END) AS recorded
        FROM pages WHERE page_id % 19 <> 0)
  SELECT path, length, sha256, recorded, CASE WHEN sha256 IS NULL THEN 'file_missing' WHEN recorded IS NULL THEN 'not_in_catalog'
         WHEN sha256 <> recorded THEN 'hash_mismatch' ELSE 'ok' END AS status FROM f FULL OUTER JOIN r USING (path)"""
ORACLES["publishable"] = f"""WITH {bars('l_partkey')}, {FAULTY} SELECT product FROM judged GROUP BY product
  HAVING count(*) FILTER (reject IS NOT NULL AND reject <> 'incomplete_bucket') = 0"""
_BROKEN = f"""{SUPPLIER_BARS}, {SNAPSHOTS},
  cut AS (SELECT b.* FROM base b JOIN refs USING (product) WHERE product::INTEGER % 7 <> 1 OR "day" + 1 < ref),
  found AS (
    SELECT product, 'baseline_last_day' AS rule FROM cut JOIN refs USING (product) GROUP BY product, ref HAVING max("day") <> ref - 1
    UNION SELECT product, 'audit_duplicate_day' FROM aud WHERE product::INTEGER % 7 = 3 AND d % 3 = 0
    UNION SELECT product, 'audit_undecodable' FROM aud WHERE product::INTEGER % 7 = 2 AND d % 5 = 0
    UNION SELECT product, 'interval_mismatch' FROM aud WHERE product::INTEGER % 7 = 4
    UNION SELECT 'x' || product, 'product_mismatch' FROM aud WHERE product::INTEGER % 7 = 5)"""
ORACLES["snapshot_pair_violations"] = f"{_BROKEN} SELECT product, rule FROM found"
ORACLES["revision_audit"] = f"""WITH good AS ({_again('revision_verdict', 'l_suppkey')}),
  bad AS ({_BROKEN} SELECT product, string_agg(rule, ',' ORDER BY rule) AS broken_rules FROM found GROUP BY product)
  SELECT product, verdict, raw_representation_stable, audit_days_after_baseline, '' AS broken_rules
  FROM good WHERE product NOT IN (SELECT product FROM bad)
  UNION ALL SELECT product, 'REJECTED', NULL, NULL, broken_rules FROM bad"""
_UNEQUAL = {"baseline": COST_SCENARIOS["baseline"], "moderately_worse": COST_SCENARIOS["moderately_worse"]}
_TWO_LEDGERS = f"""{study((BASELINE_CELL, (12, 35)), _UNEQUAL, 'l_suppkey')},
  chosen AS (SELECT *, CASE WHEN fast = 10 AND scenario = 'baseline' THEN 'l' WHEN fast = 12 AND scenario <> 'baseline' THEN 'r' END AS who FROM curve),
  numbered AS (
    SELECT symbol, who, ts, price, target, row_number() OVER (PARTITION BY symbol, who, target ORDER BY ts) AS k
    FROM chosen WHERE who IS NOT NULL AND target <> prev_target),
  both_ AS (
    SELECT symbol, target, k, a.ts AS lt, b.ts AS rt, a.price AS lp, b.price AS rp
    FROM (SELECT * FROM numbered WHERE who = 'l') a FULL OUTER JOIN (SELECT * FROM numbered WHERE who = 'r') b USING (symbol, target, k)),
  n AS (
    SELECT symbol, count(lt) FILTER (target = 0) AS left_trades, count(rt) FILTER (target = 0) AS right_trades,
           count(*) FILTER (lt IS DISTINCT FROM rt) AS date_mismatches,
           count(*) FILTER (abs(lp - rp) / greatest(abs(lp), abs(rp), 1e-12) > 1e-9) AS price_mismatches FROM both_ GROUP BY symbol),
  e AS (
    SELECT symbol, arg_max(equity, ts) FILTER (who = 'l') AS le, arg_max(equity, ts) FILTER (who = 'r') AS re FROM chosen GROUP BY symbol)"""
ORACLES["ledger_reconcile_unequal"] = f"""{_TWO_LEDGERS}
  SELECT symbol, 10 AS fast, 30 AS slow, 'baseline' AS scenario, coalesce(left_trades, 0) AS left_trades,
         coalesce(right_trades, 0) AS right_trades, coalesce(date_mismatches, 0) AS date_mismatches,
         coalesce(price_mismatches, 0) AS price_mismatches, round(le, 4) AS left_final_equity, round(re, 4) AS right_final_equity,
         round(le / {INITIAL_CASH} - 1, 8) AS left_total_return, round(re / {INITIAL_CASH} - 1, 8) AS right_total_return,
         abs(le - re) / greatest(abs(le), abs(re), 1e-12) <= 1e-9 AS equity_agrees,
         abs(le - re) / {INITIAL_CASH} <= 1e-9 AS return_agrees
  FROM e LEFT JOIN n USING (symbol)"""

ORACLES["trade_violations"] = f"""{study(symbol='l_suppkey')},
  bad AS (SELECT symbol, fast, slow, scenario, ts, CASE WHEN {DAY} % 13 = 0 THEN 'hold' ELSE side END AS side,
                 CASE WHEN side = 'sell' AND {DAY} % 11 = 0 THEN quantity * 1.5 ELSE quantity END AS quantity
          FROM fills WHERE side <> 'buy' OR {DAY} % 7 <> 0),
  seen AS (SELECT *, count(*) FILTER (side = 'buy') OVER w AS trip,
                  count(*) FILTER (side = 'buy') OVER w - count(*) FILTER (side = 'sell') OVER w
                  - CASE side WHEN 'buy' THEN 1 WHEN 'sell' THEN -1 ELSE 0 END AS open_before
           FROM bad WINDOW w AS (PARTITION BY {RUN} ORDER BY ts ROWS UNBOUNDED PRECEDING)),
  held AS (SELECT *, max(quantity) FILTER (side = 'buy') OVER (PARTITION BY {RUN}, trip) AS bought FROM seen),
  named AS (SELECT *, CASE WHEN side = 'hold' THEN 'unknown_side' WHEN side = 'buy' AND open_before > 0 THEN 'consecutive_buys'
                           WHEN side = 'sell' AND open_before < 1 THEN 'orphan_sell'
                           WHEN side = 'sell' AND abs(quantity - bought) > 1e-9 THEN 'quantity_mismatch' END AS reason FROM held)
  SELECT {RUN}, ts, side, reason FROM named WHERE reason IS NOT NULL"""


def _part(name: str, columns: str, group: bool = False, where: str = "true") -> str:
    tail = " GROUP BY symbol" if group else ""
    return f"(SELECT symbol, {columns} FROM ({ORACLES[name]}) WHERE {where}{tail})"


ORACLES["flagship"] = f"""SELECT a.* EXCLUDE (fast, slow, scenario), s.* EXCLUDE (symbol), 'ok' AS corporate_actions,
         0::BIGINT AS data_violations, i.isolated_cells, l.* EXCLUDE (symbol), p.* EXCLUDE (symbol),
         c.worst_stress_return, h.buy_and_hold_return, k.spot_checks_passed
  FROM ({ORACLES["aggregate_metrics"]}) a JOIN ({ORACLES["sign_consistency"]}) s USING (symbol)
  JOIN {_part("isolated_cells", "count(*) FILTER (isolated) AS isolated_cells", True)} i USING (symbol)
  JOIN {_part("leave_one_out", "max(largest_change) AS largest_change, count(*) FILTER (sign_flip) AS sign_flips", True, "fast = 10 AND slow = 30")} l USING (symbol)
  JOIN {_part("pnl_concentration", "largest_positive_fraction, trips_for_half", where="fast = 10 AND slow = 30")} p USING (symbol)
  JOIN {_part("cost_stress", "min(aggregate_return) AS worst_stress_return", True)} c USING (symbol)
  JOIN (SELECT symbol, total_return AS buy_and_hold_return FROM ({_again("buy_and_hold", "l_returnflag", "l_suppkey")})) h USING (symbol)
  JOIN {_part("spot_checks", "count(*) FILTER (equity_agrees AND return_agrees) AS spot_checks_passed", True)} k USING (symbol)"""


def _row_hash(columns: dict[str, str]) -> str:
    """SHA-256 of a row, as text: name, length and value by column in order of name."""
    one = [f"'{c}=' || CASE WHEN {e} IS NULL THEN '-' ELSE length({e}::VARCHAR)::VARCHAR || ':' || {e}::VARCHAR END || ';'" for c, e in sorted(columns.items())]
    return f"sha256({' || '.join(one)})"


def _digest(h: str = "h") -> str:
    lanes = " || ',' || ".join(f"coalesce(sum(('0x' || substr({h}, {1 + 5 * i}, 5))::BIGINT), 0)::VARCHAR" for i in range(12))
    return f"sha256(count(*)::VARCHAR || ',' || {lanes})"


_ORDER = {c: c for c in ("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority", "o_orderstatus")}
_EVENT = {"symbol": "symbol", "ts": "ts", "o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "o_orderpriority": "o_orderpriority"}
ORDER_WINDOWS = """ow AS (
  SELECT (o_orderkey % 100)::VARCHAR AS symbol, o_orderkey AS "window", o_orderdate AS start,
         o_orderdate + to_days(CASE WHEN o_orderkey % 100 = 0 THEN 1000 ELSE o_orderkey % 45 END::INTEGER) AS "end" FROM orders)"""
OWN_SPLITS = """hist AS (SELECT symbol, symbol::INTEGER AS n, min(ts)::DATE AS a, max(ts)::DATE AS z FROM bars GROUP BY symbol),
cuts AS (SELECT *, a + 700 + n % 7 * 50 AS one, a + 1400 + n % 11 * 40 AS two FROM hist),
own AS (
  SELECT symbol, 'train' AS split, a AS s, one AS e FROM cuts UNION ALL SELECT symbol, 'validation', one, two FROM cuts
  UNION ALL SELECT symbol, 'test', two, z - 20 FROM cuts)"""
ORACLES |= {
    "table_digests": f"""SELECT o_orderstatus, count(*) AS "rows", {_digest()} AS digest
        FROM (SELECT *, {_row_hash(_ORDER)} AS h FROM orders) GROUP BY o_orderstatus""",
    "digest_violations": """WITH r AS (
          SELECT o_custkey, CASE WHEN o_orderkey % 997 = 5 THEN 2 WHEN o_orderkey % 991 = 7 OR o_custkey % 50 = 3 THEN 0 ELSE 1 END AS n,
                 o_orderkey % 983 = 11 AS changed FROM orders),
        g AS (SELECT o_custkey, sum(n) AS n, bool_or(n <> 1 OR changed) AS differs FROM r GROUP BY o_custkey),
        j AS (SELECT o_custkey, CASE WHEN o_custkey % 40 = 9 THEN CASE WHEN n > 0 THEN 'not_recorded' END
                     WHEN n = 0 THEN 'rows_missing' WHEN differs THEN 'content_differs' END AS rule FROM g)
        SELECT * FROM j WHERE rule IS NOT NULL""",
    "research_verified": f"""WITH e AS (
          SELECT o_orderstatus AS symbol, o_orderdate AS ts, o_orderkey, o_custkey, o_orderpriority FROM orders),
        h AS (SELECT *, {_row_hash(_EVENT)} AS h FROM e)
        SELECT symbol, 'research_snapshot' AS kind, 1 AS schema_version, (SELECT {_digest()} FROM h) AS source_processed_sha256,
               'ts < 2001-01-01' AS derivation_predicate, '2001-01-01' AS research_half_open_end, count(*) AS row_count,
               strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS first_timestamp, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last_timestamp,
               {_digest()} AS content_digest
        FROM h WHERE ts < TIMESTAMP '2001-01-01' GROUP BY symbol""",
    "lineage_closure": """WITH RECURSIVE a AS (
          SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 > 0 THEN o_orderkey - 1 WHEN o_orderkey // 10 % 37 = 5 THEN o_orderkey + 9 END AS p,
                 o_orderkey // 10 % 41 = 7 AND o_orderkey % 10 = 4 AS gone, o_orderkey // 10 % 43 = 9 AND o_orderkey % 10 = 3 AS differs FROM orders),
        w AS (
          SELECT k AS k0, k, 0::BIGINT AS depth, false AS missing, false AS differs FROM a
          UNION ALL
          SELECT k0, p, depth + 1, w.missing OR gone, w.differs OR (a.differs AND NOT gone) FROM w JOIN a USING (k)
          WHERE p IS NOT NULL AND NOT w.missing AND depth < 30),
        f AS (SELECT k0, max(depth) AS depth, arg_max(k, depth) AS k, bool_or(missing) AS missing, bool_or(differs) AS differs FROM w GROUP BY k0)
        SELECT 'artifact/' || k0::VARCHAR AS path, CASE WHEN depth < 30 AND NOT missing THEN 'artifact/' || k::VARCHAR END AS root,
               CASE WHEN depth < 30 THEN depth END AS depth,
               CASE WHEN depth >= 30 THEN 'cycle' WHEN missing THEN 'parent_missing' WHEN differs THEN 'hash_differs' ELSE 'ok' END AS status
        FROM f""",
    "registry_batches": """WITH b AS (
          SELECT o_custkey AS c, count(*) AS n, bool_or(o_orderkey % 950 = 0) AS bad FROM orders GROUP BY o_custkey),
        d AS (SELECT *, 0 AS delivery, false AS known FROM b WHERE c % 3 = 0
              UNION ALL SELECT *, 1, c % 3 = 0 FROM b WHERE c % 2 = 0
              UNION ALL SELECT *, 2, c % 3 = 0 OR c % 2 = 0 FROM b WHERE c % 5 <> 1)
        SELECT 'b' || c::VARCHAR AS batch_id, n AS "rows",
               CASE WHEN bad THEN 'refused' WHEN known THEN 'already_in' ELSE 'appended' END AS status, delivery,
               CASE WHEN bad THEN 0 ELSE n END AS kept FROM d""",
    "published_rows": f"""WITH {bars('l_partkey')}, {FAULTY} SELECT product AS symbol, count(*) AS bars,
               min(make_timestamp(d * 86400000000)) AS first_ts, max(make_timestamp(d * 86400000000)) AS last_ts
        FROM judged GROUP BY product HAVING count(*) FILTER (reject IS NOT NULL AND reject <> 'incomplete_bucket') = 0""",
    "windows_by_order": f"""{SUPPLIER_BARS}, {ORDER_WINDOWS} SELECT symbol, "window", count(*) AS bars, min(ts) AS first_ts, max(ts) AS last_ts
        FROM bars JOIN ow USING (symbol) WHERE ts >= start AND ts < "end" GROUP BY ALL""",
    "split_labels_by_supplier": f"""{SUPPLIER_BARS}, {OWN_SPLITS} SELECT b.symbol, ts, close, split
        FROM bars b LEFT JOIN own o ON b.symbol = o.symbol AND ts >= s AND ts < e""",
    "research_rows_by_supplier": f"""{SUPPLIER_BARS}, {OWN_SPLITS} SELECT b.symbol, ts, close
        FROM bars b JOIN own o ON b.symbol = o.symbol AND ts >= s AND ts < e WHERE split <> 'test'""",
    "crossing_trips_by_supplier": f"""{study(symbol='l_suppkey')}, {ORDER_WINDOWS} SELECT symbol, "window", entry_ts, exit_ts
        FROM trips JOIN ow USING (symbol)
        WHERE exit_ts IS NOT NULL AND ((entry_ts < start AND start <= exit_ts) OR (entry_ts < "end" AND "end" <= exit_ts))""",
}
ORACLES["equity_before_trades"] = f"""{study(symbol='l_suppkey')} SELECT {', '.join('f.' + c.strip() for c in RUN.split(','))}, f.ts, side,
    c.ts AS as_of_ts, round(c.equity, 4) AS equity, CASE WHEN c.ts IS NULL THEN 'no_earlier_row' ELSE 'ok' END AS status
  FROM fills f ASOF LEFT JOIN (SELECT {RUN}, ts, equity FROM curve) c
    ON {' AND '.join(f'f.{c.strip()} = c.{c.strip()}' for c in RUN.split(','))} AND f.ts > c.ts"""
ORACLES["cutoff_violations"] = """SELECT 'late' AS "case", 'row_after_cutoff' AS rule FROM (SELECT max(l_shipdate) AS m FROM lineitem) WHERE m >= TIMESTAMP '2000-01-01'
  UNION ALL SELECT 'empty', 'no_rows' FROM (SELECT count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1900-01-01') WHERE n = 0"""
ORACLES["divergences_unequal"] = f"""{_TWO_LEDGERS},
  d AS (
    SELECT symbol, CASE WHEN target = 1 THEN 'entry_dates' ELSE 'exit_dates' END AS field, k AS ordinal, 'dates differ exactly' AS explanation
    FROM both_ WHERE lt IS DISTINCT FROM rt
    UNION ALL SELECT symbol, 'execution_price', k, 'relative difference exceeds 1e-9' FROM both_
    WHERE abs(lp - rp) / greatest(abs(lp), abs(rp), 1e-12) > 1e-9
    UNION ALL SELECT symbol, 'num_trades', NULL, 'completed trade counts differ exactly' FROM n WHERE left_trades <> right_trades
    UNION ALL SELECT symbol, 'execution_price_count', NULL, 'different number of trades' FROM both_ GROUP BY symbol HAVING count(lt) <> count(rt)
    UNION ALL SELECT symbol, 'final_equity', NULL, 'relative difference exceeds 1e-9' FROM e WHERE abs(le - re) / greatest(abs(le), abs(re), 1e-12) > 1e-9
    UNION ALL SELECT symbol, 'total_return', NULL, 'absolute difference exceeds 1e-9' FROM e WHERE abs(le - re) / {INITIAL_CASH} > 1e-9)
  SELECT symbol, 10 AS fast, 30 AS slow, 'baseline' AS scenario, field, ordinal, explanation FROM d"""
ORACLES["price_medians"] = """SELECT l_returnflag, count(*) AS count, round(median(l_extendedprice), 4) AS median FROM lineitem GROUP BY l_returnflag"""
for _name in ("crossover_signal_stored", "crossover_signal_stream"):
    ORACLES[_name] = _again("crossover_signal", "l_suppkey")
