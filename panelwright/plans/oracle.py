"""The registered queries restated as DuckDB SQL over the same tables."""

from __future__ import annotations

from ..functions import draws
from ..operators import rules, text
from ..sources import dims

PX = """px as (select p_brand ticker, cast(l_shipdate as date) date, avg(l_quantity) q, cast(sum(l_quantity) as bigint) volume from lineitem join part on l_partkey = p_partkey group by 1, 2),
prices as (select ticker, date, 100 * exp(sum(cast(round((q - 25.5) * 1000) as bigint)) over (partition by ticker order by date) / 1e6) "close", volume from px)"""

def drawn(source: str, key: str, seed: int, counter: str, counters: str = "") -> str:
    """``source`` with ``u``, the draw of its rows' key (a text expression) and counter, below 2**31: :mod:`..functions.draws` written out.

    ``counters``: a table joined after the key has been stirred in.
    """
    low = draws.SPAN - 1

    def stirred(v: str, name: str, sql: str, also: str = "") -> str:
        sql = f"select *, (({v}) & {low}) * {draws.A} & {low} {name}1 from ({sql}){also}"
        sql = f"select *, xor({name}1, {name}1 >> 15) * {draws.B} & {low} {name}2 from ({sql})"
        return f"select *, xor({name}2, {name}2 >> 13) {name} from ({sql})"

    sql = f"select *, cast('0x' || substr(md5({key}), 1, 13) as bigint) number from {source}"
    sql = stirred("xor(du, number >> 31)", "dv", stirred(f"(number & {low}) + {seed}", "du", sql))
    return stirred(f"dv + {counter}", "u", sql, counters)


_Q = {"fast": 2 / 13, "slow": 2 / 27, "g": 1 / 14, "l": 1 / 14}


def _ema(x: str, a: float) -> str:
    return f"power(1 - {a!r}, rn) * sum(case when rn = 0 then 1 else {a!r} end * {x} * power(1 - {a!r}, -rn)) over w"


IND = f"""{PX},
r0 as (select *, "close" close_price, row_number() over w - 1 rn, count(*) over (partition by ticker) n_rows, lag("close") over w pc, lead("close", 30) over w fc from prices window w as (partition by ticker order by date)),
r1 as (select *, ("close" - pc) / pc daily_return, coalesce(greatest("close" - pc, 0), 0) gain, coalesce(greatest(pc - "close", 0), 0) loss, (fc - "close") / "close" fwd_return from r0),
r2 as (select *, {_ema('"close"', 2 / 13)} e_fast, {_ema('"close"', 2 / 27)} e_slow, {_ema('gain', 1 / 14)} g, {_ema('loss', 1 / 14)} l,
  case when rn >= 4 then avg("close") over (partition by ticker order by date rows 4 preceding) end ma_5,
  case when rn >= 19 then avg("close") over (partition by ticker order by date rows 19 preceding) end ma_20,
  case when rn >= 49 then avg("close") over (partition by ticker order by date rows 49 preceding) end ma_50,
  case when rn >= 20 then stddev_samp(daily_return) over (partition by ticker order by date rows 19 preceding) end volatility
  from r1 window w as (partition by ticker order by date)),
ind as (select *, e_fast - e_slow macd, case when rn >= 13 then case when l > 0 then 100 - 100 / (1 + g / l) when g > 0 then 100.0 end end rsi from r2),
feat as (select * from ind where n_rows >= 80 and rn >= 49 and rsi is not null and volatility is not null),
lab as (select *, case when fwd_return > 0.1 then 'Buy' when fwd_return >= 0 then 'Hold' else 'Avoid' end target from feat where fwd_return is not null)"""

PRED = f"""{IND},
pred as (select ticker, date, target y_true, model, case model when 'rsi' then case when rsi < 30 then 'Buy' when rsi > 70 then 'Avoid' else 'Hold' end when 'macd' then case when macd > 0 then 'Buy' else 'Avoid' end else 'Avoid' end y_pred
  from lab cross join (values ('rsi'), ('macd'), ('always_avoid')) m(model))"""

SIG = f"""{IND},
lp as (select *, row_number() over (partition by ticker order by date) - 1 p, count(*) over (partition by ticker) n from lab),
sig as (select ticker, cast(w as integer) window_id, cast(p - w * 60 - 500 as integer) i, date, "close", case when rsi < 45 then 'Buy' when rsi > 60 then 'Avoid' else 'Hold' end pred, target, n panel_rows
  from lp, unnest(range(0, (n - 560) // 60 + 1)) t(w) where n >= 560 and p >= w * 60 + 500 and p < w * 60 + 560)"""

LEDGER = f"""{SIG},
a0 as (select *, count(*) over (partition by ticker, window_id) n, lag(pred) over w b1, lag(pred, 2) over w b2, lead(pred) over w nx, lead("close") over w nc from sig window w as (partition by ticker, window_id order by i)),
a1 as (select *, pred = 'Buy' and coalesce(b1, '') <> 'Buy' starts, pred <> 'Buy' and coalesce(b1, '') = 'Buy' spent from a0),
a2 as (select *, sum(cast(starts as int)) over (partition by ticker, window_id order by i) run from a1),
tr as (select ticker, window_id, run, min(i) filter (pred = 'Buy') entry_i, max(i) exit_i, min(date) entry_date, max(date) exit_date, arg_min("close", i) entry_price, arg_max("close", i) exit_price, max(n) n_rows from a2 where pred = 'Buy' or spent group by 1, 2, 3),
trades as (select *, (exit_price - entry_price) / entry_price - 0.002 net_return, exit_i - entry_i holding_days from tr),
pts as (select a2.ticker, a2.window_id, a2.i, a2.date, pred kind, case when pred = 'Buy' then net_return when pred = 'Hold' and nc is not null then
    0.5 * ((nc - "close") / "close" - (case when b1 = 'Hold' and coalesce(b2, '') <> 'Buy' then 0 else 0.001 end + case when nx = 'Hold' and a2.i + 2 < n then 0 else 0.001 end)) else 0.0 end r
  from a2 left join trades t on t.ticker = a2.ticker and t.window_id = a2.window_id and t.entry_i = a2.i and a2.starts where starts or (pred <> 'Buy' and not spent)),
eq as (select *, row_number() over w seq, product(1 + r) over w * 10000 as value from pts window w as (partition by ticker order by window_id, i)),
bw as (select ticker, window_id, arg_min("close", i) a, arg_max("close", i) b, count(*) n from sig group by 1, 2),
bench as (select ticker, window_id, product(1 + case when n >= 2 then (b - a) / a else 0 end) over (partition by ticker order by window_id) * 10000 as value from bw)"""

CURVE = """cv as (select ticker, seq, value, value / lag(value) over (partition by ticker order by seq) - 1 c, (value - max(value) over (partition by ticker order by seq)) / max(value) over (partition by ticker order by seq) d from eq),
cm as (select ticker, arg_max(value, seq) final_value, count(c) n_changes, case when count(c) > 1 and stddev_samp(c) > 0 then avg(c) / stddev_samp(c) * sqrt(252) else 0 end sharpe, min(d) * 100 max_drawdown from cv group by 1),
bm as (select ticker, arg_max(value, window_id) / 10000 - 1 benchmark_return from bench group by 1),
tw as (select ticker, count(*) n_trades, count(*) filter (net_return > 0) n_wins from trades group by 1),
sn as (select ticker, avg(case when pred = target then 1.0 else 0.0 end) accuracy, max(panel_rows) - 500 as days from sig group by 1),
met as (select cm.ticker, final_value, final_value / 10000 - 1 total_return, sharpe, max_drawdown, n_changes, benchmark_return, accuracy, cast(days as bigint) as days, coalesce(n_trades, 0) n_trades, coalesce(n_wins, 0) n_wins,
  power(final_value / 10000, 252 / cast(days as double)) - 1 annual_return, power(1 + benchmark_return, 252 / cast(days as double)) - 1 annual_benchmark, coalesce(n_wins / nullif(cast(n_trades as double), 0), 0) win_rate, final_value / 10000 - 1 - benchmark_return excess_return from cm join bm using (ticker) join sn using (ticker) left join tw using (ticker))"""

STOCKS = """stocks as (select distinct p_brand ticker, cast(regexp_extract(p_brand, '[0-9]+') as integer) position, 'Sector ' || cast(cast(regexp_extract(p_brand, '[0-9]+') as integer) % 5 as varchar) sector from part)"""

SNAP = f"""{IND}, {STOCKS},
ls as (select ticker, rsi, macd, volatility * 100 volatility, case when rsi < 45 then 'Buy' when rsi > 60 then 'Avoid' else 'Hold' end signal from feat qualify row_number() over (partition by ticker order by date desc) = 1),
hs as (select ticker, arg_max("close", date) current_price, case when count(*) > 22 then (arg_max("close", date) / max("close") filter (b = 22) - 1) * 100 else 0.0 end price_change_30d
  from (select *, row_number() over (partition by ticker order by date desc) b from prices) group by 1),
snap as (select * from ls join hs using (ticker) join stocks using (ticker))"""

_RATE = {
    "Use Caution": "(risk in ('Conservative', 'Moderately Conservative') and signal = 'Buy') or (risk in ('Balanced', 'Moderate') and signal = 'Hold') or (risk in ('Growth', 'Aggressive') and signal = 'Avoid')",
    "Suitable": "(risk in ('Balanced', 'Moderate') and signal = 'Buy') or (risk in ('Growth', 'Aggressive') and signal in ('Buy', 'Hold'))",
    "Not Suitable": "(risk in ('Conservative', 'Moderately Conservative') and signal in ('Hold', 'Avoid')) or (risk in ('Balanced', 'Moderate') and signal = 'Avoid')",
}


def rating(risk: str, signal: str = "signal") -> str:
    import re

    out = " ".join(f"when {c} then '{k}'" for k, c in _RATE.items())
    return "case " + re.sub(r"\bsignal\b", signal, re.sub(r"\brisk\b", risk, out)) + " end"


def band(total: str, shift: int = 0) -> str:
    return f"case when {total} < 5 or {total} > 20 then null when {total} <= {8 + shift} then 'Conservative' when {total} <= {11 + shift} then 'Moderately Conservative' when {total} <= {14 + shift} then 'Balanced' when {total} <= {17 + shift} then 'Growth' else 'Aggressive' end"


RESP = """resp as (select cast(c_custkey as bigint) respondent_id, 'q' || j item_id, cast(greatest(1, least(4, c_custkey % 4 + cast('0x' || substr(md5(cast(c_custkey as varchar) || '-' || j), 1, 6) as bigint) % 3)) as integer) score from customer, unnest(range(0, 5)) t(j)),
tot as (select respondent_id, cast(sum(score) as integer) total from resp group by 1)"""
INVEST = f"""{RESP}, inv as (select respondent_id investor_id, {band('total')} risk from tot)"""
RATED = f"""{SNAP}, {INVEST},
rated as (select *, {rating('risk')} rating from inv cross join snap),
ranked as (select *, row_number() over (partition by investor_id order by case rating when 'Suitable' then 0 when 'Use Caution' then 1 when 'Not Suitable' then 2 else 3 end, position) rank from rated)"""

MSG = """msg0 as (select cast(conv_id * 1000 + turn as bigint) message_id, text from conversations where role = 'user'),
msg as (select message_id, case when message_id % 3 = 0 then ['Why is it risky? ', 'Compare with the rest: ', 'Should I buy? ', 'Tell me about ', 'How is my portfolio? '][message_id % 5 + 1] || 'brand#' || cast(message_id % 25 + 1 as varchar) || ', ' || text else text end text from msg0)"""
_ALONE = r"contains(upper(text), word) and regexp_matches(upper(text), '(^|[^\p{L}\p{N}_])' || regexp_escape(word) || '($|[^\p{L}\p{N}_])')"
_NAMES = "['Amber', 'Basalt', 'Cobalt', 'Dolomite', 'Energy'][position % 5 + 1]"


def _any(terms: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains(t, '{x}')" for x in terms) + ")"


INTENT = f"""{MSG}, {STOCKS},
alias as (select upper(ticker) word, ticker, position, 0 kind from stocks union select upper({_NAMES}), ticker, position, 1 from stocks where {_NAMES} <> 'Energy' union select 'MAKER', ticker, position, 1 from stocks),
hit as (select message_id, ticker, position, min(kind) kind from msg, alias where {_ALONE} group by 1, 2, 3),
tick as (select message_id, string_agg(ticker, ',' order by kind, position) tickers from hit group by 1),
intent as (select message_id, coalesce(tickers, '') tickers, case
  when {_any(('compare', ' vs ', 'versus', 'difference between', 'which is better'))} then 'compare'
  when why and {_any(('recommend', 'suitable', 'suggest', 'pick'))} then 'explain_recommendation'
  when why and (tickers is not null or {_any(('risk', 'rating'))}) then 'explain_risk'
  when {_any(('risk', 'dangerous', 'volatile', 'safe'))} then 'risk_analysis'
  when {_any(('industry', 'sector', 'what does', 'what is', 'tell me about', 'info'))} then 'stock_info'
  when {_any(('best', 'should i buy', 'what should', 'recommend me', 'top pick', 'suggestion'))} then 'best_pick'
  when {_any(('portfolio', 'diversif', 'all stocks', 'overall'))} then 'portfolio_overview'
  when tickers is not null then 'stock_info' else 'general_help' end intent
  from (select *, lower(text) t, {_any(('why', 'reason', 'explain', 'how come', 'based on', 'what makes', 'how is')).replace('(t,', '(lower(text),')} why from msg) left join tick using (message_id))"""

GUARD = f"""{SNAP},
f as (select ticker, {rating("'Balanced'")} rating, signal from snap),
pr as (select a.ticker a, a.rating ra, a.signal sa, b.ticker b, b.rating rb, b.signal sb from f a join f b on a.ticker <> b.ticker),
cases as (
  select a || '|' || b || '|' || k summary_id, contradicts, case k when 1 then true else contradicts and k <> 99 end unused, k, a, b, ra, rb, sa, sb from pr, (values (0, false), (1, false), (2, false), (3, false), (4, false), (5, false), (6, false), (7, true), (8, true), (9, true), (10, true), (99, true)) v(k, contradicts)
  where k < 7 or (k in (7, 9) and ra <> rb) or (k in (8, 10) and sa <> sb) or (k = 99 and ra = 'Suitable')),
verdicts as (select summary_id, contradicts, not contradicts accepted from cases)"""

_WILSON = "case when n > 0 then ({c} {s} 1.959963984540054 * sqrt(p * (1 - p) / n + 3.841458820694124 / (4 * n * n)) / (1 + 3.841458820694124 / n)) end"


def wilson(k: str, n: str) -> tuple[str, str, str]:
    z2, z = "3.841458820694124", "1.959963984540054"
    p = f"({k} / cast({n} as double))"
    centre = f"(({p} + {z2} / (2.0 * {n})) / (1 + {z2} / {n}))"
    half = f"({z} * sqrt({p} * (1 - {p}) / {n} + {z2} / (4.0 * {n} * {n})) / (1 + {z2} / {n}))"
    return p, f"greatest(0.0, {centre} - {half})", f"least(1.0, {centre} + {half})"


def rnd(*columns: str) -> str:
    """"x" or "expression name" -> rounded to six decimals under that name."""
    out = []
    for c in columns:
        expression, _, name = c.rpartition(" ")
        out.append(f"round({expression or name}, 6) + 0.0 {name}")
    return ", ".join(out)


def rnd4(*columns: str) -> str:
    """:func:`rnd` to four decimals, for values that hundreds of sums lead to."""
    return rnd(*columns).replace(", 6) + 0.0 ", ", 4) + 0.0 ")


REPORT = """cells as (select {by}, y_true, y_pred, count(*) n from pred group by all),
rep0 as (select {by}, label, sum(s) support, sum(p) predicted, sum(h) hits from (select {by}, y_true label, n s, 0 p, case when y_true = y_pred then n else 0 end h from cells union all select {by}, y_pred, 0, n, 0 from cells) group by all),
rep as (select *, coalesce(hits / nullif(cast(predicted as double), 0), 0) "precision", coalesce(hits / nullif(cast(support as double), 0), 0) recall from rep0),
rp as (select *, coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0) f1 from rep),
sc as (select {by}, cast(sum(support) as bigint) n_test, sum(hits) / cast(sum(support) as double) accuracy, avg(recall) filter (support > 0) balanced_accuracy, sum("precision" * support) / sum(support) precision_weighted, sum(recall * support) / sum(support) recall_weighted, sum(f1 * support) / sum(support) f1_weighted, avg(f1) f1_macro from rp group by all)"""


def report(by: str) -> str:
    return REPORT.replace("{by}", by)


_W = wilson("k", "n")
_G = wilson("tp", "(tp + fn)")

def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_LISTED = "listed(ticker, name, position) as (values " + ", ".join(f"({_quoted(t)}, {_quoted(n)}, {i})" for i, (t, n, _) in enumerate(dims.EXTENDED, 1)) + ")"
_COMMON = ", ".join(map(_quoted, text.COMMON_NAME_WORDS))
_LISTED_MSG = f"""{_LISTED}, msg0 as (select cast(conv_id * 1000 + turn as bigint) message_id, text from conversations where role = 'user'),
msg as (select message_id, case when message_id % 2 = 0 then ['Is it risky, ', 'Compare with ', 'Why is it suitable? ', 'Tell me about ', ''][message_id % 5 + 1] || case when message_id % 6 = 0 then '#' else '' end || lower(ticker) || '? ' || text else text end text from msg0 join listed on position = message_id % 100 + 1),
alias as (select ticker word, ticker, position, 0 kind from listed union select w, ticker, position, 1 from (select ticker, position, unnest(regexp_extract_all(upper(name), '[A-Z]+')) w from listed) where length(w) > 3 and w not in ({_COMMON})),
hit as (select message_id, ticker, position, min(kind) kind from msg, alias where {_ALONE} group by 1, 2, 3),"""
LISTED = _LISTED_MSG + INTENT[INTENT.index("tick as (") - 1 :]

_ROW = "ticker || '|' || strftime(date, '%Y-%m-%d')"
_BASES = f"""{IND}, d as (select date, row_number() over (order by date) - 1 pos, count(*) over () n from (select distinct date from lab)), s as (select greatest(1, least(cast(round_even(any_value(n) * 0.8, 0) as bigint), any_value(n) - 1)) sp from d), m as (select max(date) filter (pos = sp) sd, max(date) filter (pos = greatest(0, sp - 30)) pd from d, s),
t as (select count(*) filter (target = 'Avoid') / count(*) a, count(*) filter (target in ('Avoid', 'Buy')) / count(*) b, arg_max(target, k) major from (select target, count(*) over (partition by target) - case target when 'Avoid' then 0.1 when 'Buy' then 0.2 else 0.3 end k from lab, m where date < pd)),
c as (select * from lab, m, (values (0), (1)) z(i) where date >= sd)"""


def _bases(h: str) -> str:
    u = "u / 2147483648.0"
    return f"""select ticker, date, target y_true, 'stratified' model, case when {u} < a then 'Avoid' when {u} < b then 'Buy' else 'Hold' end y_pred from {h}, t where i = 0
  union all select ticker, date, target, 'uniform', case when {u} < 1 / 3.0 then 'Avoid' when {u} < 2 / 3.0 then 'Buy' else 'Hold' end from {h} where i = 1"""


_EDGES = " + ".join(f"cast(u >= {e} as int)" for e in draws.poisson_edges())

SQL = {
    "label_counts": f"with {IND} select ticker, target as label, count(*) n, {rnd('count(*) / sum(count(*)) over (partition by ticker) share')} from lab group by ticker, target",
    "price_panel": f"with {PX} select ticker, date, {rnd('\"close\" \"close\"')}, volume from prices",
    "price_scan": f"with {PX} select ticker, date, {rnd('\"close\" \"close\"')}, volume from prices where date >= date '1996-01-01' and date < date '1997-01-01' and ticker in ('Brand#1', 'Brand#2', 'Brand#13')",
    "stored_periods": f"""with {PX}, p as (select *, cast(regexp_extract(ticker, '[0-9]+') as integer) k from prices where date >= date '1996-06-01' and date < date '1997-10-01')
select ticker, date, round(case when date < date '1997-01-01' then case when k = 5 then 3 else 1 end when k in (4, 7) and date < date '1997-07-01' then 2 else 1 end * "close", 6) "close", volume
from p where date < date '1997-01-01' or k % 2 = 0 or (k = 7 and date < date '1997-07-01')""",
    "required_columns": f"with {PX} select ticker, date, cast(null as double) open, cast(null as double) high, cast(null as double) low, {rnd('\"close\" \"close\"')}, volume from prices",
    "result_sink": f"with {IND} select ticker, target as label, count(*) n, {rnd('count(*) / sum(count(*)) over (partition by ticker) share')} from lab group by ticker, target",
    "profile_table": "select cast(c_custkey as bigint) investor_id, cast(18 + c_custkey % 70 as integer) age, cast(c_acctbal as double) income, cast(1 + c_custkey % 30 as integer) horizon, cast(c_custkey % 31 as integer) experience, cast(1 + c_custkey % 10 as integer) risk_score from customer",
    "price_normalised": f"with {PX} select ticker, date, {rnd('\"close\" \"close\"')}, volume, round(case when day(date) % 7 <> 0 then \"close\" * 0.5 end, 6) adj_close, round(case when day(date) % 7 <> 0 then \"close\" * 0.5 else \"close\" end, 6) close_price from prices",
    "null_report": f"with {PX} select ticker, count(*) rows_before, count(*) filter (day(date) <> 13) rows_after, count(*) filter (day(date) = 13) dropped from prices group by 1",
    "history_gate": f"with {PX} select ticker, count(*) n_rows, count(*) >= 1400 kept, case when count(*) < 1400 then cast(count(*) as varchar) || ' rows, needs 1400' end reason, count(*) < 1000 short_history from prices group by 1",
    "sanitised": f"with {IND} select ticker, date, {rnd4('coalesce(ma_50,0) ma_50', 'coalesce(rsi,0) rsi', 'coalesce(volatility,0) volatility')} from ind",
    "profile_validation": """select cast(c_custkey as bigint) investor_id, cast(len(e) as integer) n_errors, array_to_string(e, '; ') errors from (select c_custkey, list_filter([
        case when c_custkey % 11 = 0 then 'Missing field ''age'': must be int in range [18, 120]'
             when age not between 18 and 120 then 'Invalid field ''age'': must be int in range [18, 120], got ' || age end,
        case when income not between 0 and 999999999.99 then 'Invalid field ''income'': must be float in range [0.0, 999999999.99], got ' || cast(income as varchar) end], lambda x: x is not null) e
        from (select c_custkey, 18 + c_custkey % 70 + case when c_custkey % 13 = 0 then 100 else 0 end age, round(cast(c_acctbal as double), 2) income from customer))""",
    "domain_checks": """select cast(c_custkey as bigint) investor_id, case when x in ('balanced', 'Unknown') then 'Invalid Risk_Category: must be one of [''Aggressive'', ''Balanced'', ''Conservative'', ''Growth'', ''Moderate'', ''Moderately Conservative''], got ''' || x || '''' end error
        from (select c_custkey, ['Balanced', 'balanced', 'Growth', 'Unknown'][c_custkey % 4 + 1] x from customer)""",
    "lookups": f"with {STOCKS} select coalesce(s.sector, 'Unknown') sector, s.ticker is not null found, count(*) n from (select case when p_partkey % 10 = 0 then 'Nobody' else lower(p_brand) end asked from part) a left join stocks s on upper(a.asked) = upper(s.ticker) group by 1, 2",
    "daily_returns": f"with {IND} select ticker, date, {rnd('daily_return')} from ind",
    "moving_averages": f"with {IND} select ticker, date, {rnd('ma_5', 'ma_20', 'ma_50')} from ind",
    "gains_losses": f"with {IND} select ticker, date, {rnd('gain', 'loss')} from ind",
    "ema": f"with {PX}, r as (select *, row_number() over (partition by ticker order by date) - 1 rn from prices) select ticker, date, {rnd(_ema('\"close\"', 2 / 13) + ' ema_12', _ema('\"close\"', 2 / 27) + ' ema_26', _ema('\"close\"', 1 / 14) + ' ema_wilder')} from r window w as (partition by ticker order by date)",
    "rsi_macd": f"with {IND} select ticker, date, {rnd4('rsi', 'macd', 'volatility')} from ind",
    "features": f"with {IND} select ticker, date, cast(rn as integer) rn, volume, {rnd4('close_price', 'daily_return', 'ma_5', 'ma_20', 'ma_50', 'volatility', 'rsi', 'macd')} from feat",
    "labelled_panel": f"with {IND} select ticker, date, target, {rnd4('close_price', 'rsi', 'macd', 'fwd_return')} from lab",
    "sequence_windows": f"with {IND} select ticker, date, 20 n, {rnd('first_close', 'last_close', 'sum_return')}, target from (select *, row_number() over w k, first_value(close_price) over (partition by ticker order by date rows 19 preceding) first_close, close_price last_close, sum(daily_return) over (partition by ticker order by date rows 19 preceding) sum_return from lab window w as (partition by ticker order by date)) where k >= 20",
    "latest_features": f"with {IND} select ticker, date, {rnd('close_price', 'rsi', 'macd', 'volatility')} from feat qualify row_number() over (partition by ticker order by date desc) = 1",
    "price_history": f"with {SNAP}, t as (select *, row_number() over (partition by ticker order by date desc) b from prices) select ticker, {rnd('max(current_price) current_price', 'max(price_change_30d) price_change_30d')}, string_agg(strftime(date, '%Y-%m-%d'), ',' order by date) dates, {rnd('sum(\"close\") sum_prices')}, cast(count(*) as integer) n from t join hs using (ticker) where b <= 90 group by ticker",
    "rebased_prices": f"with {PX} select ticker, date, {rnd('\"close\" / first_value(\"close\") over (partition by ticker order by date) * 100 rebased')} from prices",
    "drawdowns": f"with {PX}, p as (select *, max(\"close\") over (partition by ticker order by date) peak from prices) select ticker, date, {rnd('peak', '(\"close\" - peak) / peak drawdown')} from p",
    "worst_drawdowns": f"with {PX}, p as (select *, \"close\" / first_value(\"close\") over (partition by ticker order by date) * 100 rb from prices), q as (select *, max(rb) over (partition by ticker order by date) peak from p) select ticker, {rnd('min((rb - peak) / peak) * 100 relative', 'min(rb - peak) points')} from q group by 1",
    "blocked_panel": f"with {IND} select ticker, date, target, {rnd4('ma_5', 'ma_20', 'ma_50', 'volatility', 'rsi', 'macd', 'fwd_return')} from lab",
    "blocked_sequences": f"with {IND} select ticker, date, 20 n, {rnd('first_close', 'sum_return')} from (select *, row_number() over w k, first_value(close_price) over (partition by ticker order by date rows 19 preceding) first_close, sum(daily_return) over (partition by ticker order by date rows 19 preceding) sum_return from lab window w as (partition by ticker order by date)) where k >= 20",
    "long_series": """with recursive l as (select row_number() over (order by event_id) - 1 rn, event_id pos, coalesce(cast(value as double), 0) x from events),
q as (select rn, pos, x, case when rn >= 19 then avg(x) over (order by rn rows 19 preceding) end ma_20, power(0.999, rn % 50000) * sum(case when rn = 0 then 1.0 else 0.001 end * x * power(0.999, -(rn % 50000))) over (partition by rn // 50000 order by rn) loc from l),
e as (select rn // 50000 b, arg_max(loc, rn) z, count(*) c from q group by 1),
c(b, carry) as (select cast(0 as bigint), cast(0 as double) union all select e.b + 1, e.z + power(0.999, e.c) * c.carry from c join e on e.b = c.b),
s as (select q.*, loc + power(0.999, rn % 50000 + 1) * carry slow from q join c on c.b = q.rn // 50000),
y as (select a.rn, sum(b.x * case when b.rn = 0 then 1.0 else 0.6 end * power(0.4, a.rn - b.rn)) quick from l a join l b on b.rn between a.rn - 45 and a.rn group by 1)
select pos, rn, round(ma_20, 4) ma_20, round(slow, 4) slow, round(quick, 4) quick, round(max(slow) over (order by rn), 4) peak, round(slow - max(slow) over (order by rn), 4) + 0.0 drawdown from s join y using (rn)""",
    "date_positions": f"with {PX} select date, cast(row_number() over (order by date) - 1 as integer) pos from (select distinct date from prices)",
    "matrix_monotone": f"""with {RATED},
m as (select distinct risk, signal, case when risk = 'Growth' and signal = 'Hold' then 'Not Suitable' else rating end rating from ranked where not (risk = 'Balanced' and signal = 'Avoid')),
r(risk, rp) as (values ('Conservative', 0), ('Moderately Conservative', 1), ('Balanced', 2), ('Growth', 3), ('Aggressive', 4)), s(signal, sp) as (values ('Avoid', 0), ('Hold', 1), ('Buy', 2)),
l(rating, lv) as (values ('Not Suitable', 0), ('Use Caution', 1), ('Suitable', 2)), g as (select * from r cross join s),
x as (select *, lag(lv) over (partition by signal order by rp) a, lag(lv) over (partition by risk order by sp) b from g join m using (risk, signal) join l using (rating))
select 'missing' kind, risk || '/' || signal "where" from g anti join m using (risk, signal) union all select 'risk order', risk || '/' || signal from x where lv < a union all select 'signal order', risk || '/' || signal from x where lv < b""",
    "purged_split": f"with {IND}, d as (select date, row_number() over (order by date) - 1 pos, count(*) over () n from (select distinct date from lab)), s as (select greatest(1, least(cast(round_even(any_value(n) * 0.8, 0) as bigint), any_value(n) - 1)) sp from d), m as (select max(date) filter (pos = sp) sd, max(date) filter (pos = greatest(0, sp - 30)) pd from d, s) select case when date < pd then 'train' when date < sd then 'purged' else 'test' end side, count(*) n, min(date) \"first\", max(date) \"last\" from lab, m group by 1",
    "row_cut_split": f"with {IND}, o as (select date, ticker, row_number() over (order by date, ticker) - 1 p, count(*) over () n from lab), c as (select date cd from o where p = cast(floor(n * 0.8) as bigint)) select case when p >= floor(n * 0.8) then 'test' when date < cd - 60 then 'train' else 'purged' end side, count(*) n, min(date) \"first\", max(date) \"last\" from o, c group by 1",
    "stratified_split": f"with {IND}, h as ({drawn('lab', _ROW, 42, '0')}) select ticker, date, target, case when row_number() over (partition by target order by u, ticker, date) <= floor(count(*) over (partition by target) * 0.8) then 'train' else 'test' end side from h",
    "walk_forward": f"with {PX}, p as (select ticker, date, row_number() over (partition by ticker order by date) - 1 p, count(*) over (partition by ticker) n from prices) select ticker, cast(w as integer) window_id, case when p < w * 60 + 500 then 'train' else 'test' end side, count(*) n, min(date) \"first\", max(date) \"last\" from p, unnest(range(0, (n - 560) // 60 + 1)) t(w) where n >= 560 and p >= w * 60 and p < w * 60 + 560 group by all",
    "regime_split": f"with {IND}, g(regime, a, b) as (values ('first', date '1995-01-01', date '1996-12-31'), ('second', date '1997-01-01', date '1998-06-30'), ('third', date '1998-07-01', date '1999-12-31'), ('fourth', date '2000-01-01', date '2001-12-31')), x as (select regime, 'test' side, date from lab join g on date between a and b union all select regime, 'train', date from lab join g on date < a - 60), k as (select regime from x group by 1 having count(*) filter (side = 'train') >= 1000 and count(*) filter (side = 'test') >= 50) select regime, side, count(*) n, max(date) \"last\" from x semi join k using (regime) group by all",
    "trailing_validation": f"with {IND}, p as (select ticker, date, row_number() over (partition by ticker order by date) k, count(*) over (partition by ticker) n from lab) select ticker, case when k > n - greatest(1, least(floor(n * 0.15), n - 1)) then 'validation' else 'train' end side, count(*) n, min(date) \"first\" from p group by all",
    "profile_columns": f"with {IND}, u as (unpivot (select close_price, coalesce(daily_return, 'nan') daily_return, coalesce(ma_50, 'nan') ma_50, coalesce(rsi, 'nan') rsi, macd from ind) on close_price, daily_return, ma_50, rsi, macd into name \"column\" value x), v as (select \"column\", case when not isnan(x) then x end x from u) select \"column\", count(*) n, count(*) - count(x) missing, {rnd('avg(x) mean', 'stddev_samp(x) sd', 'min(x) min', 'max(x) max')} from v group by 1",
    "correlations": f"with {IND} " + " union all ".join(f"select '{a}' a, '{b}' b, round(corr({a}, {b}), 6) r from lab" for i, a in enumerate(("daily_return", "volatility", "rsi", "macd", "fwd_return")) for b in ("daily_return", "volatility", "rsi", "macd", "fwd_return")[i + 1 :]),
    "sectors": f"with {STOCKS} select sector, string_agg(ticker, ',' order by position) tickers from stocks group by 1",
    "model_scores": f"with {PRED}, {report('model')} select model, n_test, {rnd('accuracy', 'balanced_accuracy', 'precision_weighted', 'recall_weighted', 'f1_weighted', 'f1_macro')} from sc",
    "confusion": f"with {PRED} select model, y_true, count(*) filter (y_pred = 'Avoid') \"Avoid\", count(*) filter (y_pred = 'Buy') \"Buy\", count(*) filter (y_pred = 'Hold') \"Hold\" from pred group by all",
    "class_report": f"with {PRED}, {report('model')} select model, label, cast(support as bigint) support, cast(predicted as bigint) predicted, cast(hits as bigint) hits, {rnd('\"precision\" \"precision\"', 'recall', 'f1')} from rp",
    "best_model": f"with {PRED}, {report('model')}, b as (select * from sc where model <> 'always_avoid' order by f1_weighted desc, accuracy desc limit 1), z as (select max(f1_weighted) bf from sc where model = 'always_avoid') select model, {rnd('f1_weighted', 'accuracy', 'bf baseline_f1', 'f1_weighted-bf margin')}, f1_weighted - bf < 0.05 negligible from b, z",
    "buy_recall": f"with {PRED} select model, {rnd('avg(case when y_pred = $$Buy$$ then 1.0 else 0.0 end) recall')}, count(*) support from pred where y_true = 'Buy' group by 1",
    "score_stability": f"with {PRED}, {report('model, ticker')} select model, {rnd('avg(accuracy) accuracy_mean', 'min(accuracy) accuracy_min', 'max(accuracy) accuracy_max', 'avg(f1_macro) f1_macro_mean', 'min(f1_macro) f1_macro_min', 'max(f1_macro) f1_macro_max')} from sc group by 1",
    "comparable_scores": f"with {PRED}, k as (select ticker, date, row_number() over (partition by ticker order by date) k from lab) select model, count(*) n_test, {rnd('avg(case when y_true = y_pred then 1.0 else 0.0 end) accuracy')} from pred join k using (ticker, date) where k >= 20 group by 1",
    "risk_classes": "select cast(c_custkey as bigint) investor_id, ['Aggressive', 'Moderate', 'Conservative'][least(2, case when 1 + c_custkey % 10 <= 3 then 2 when 1 + c_custkey % 10 <= 6 then 1 else 0 end + cast(18 + c_custkey % 70 > 60 as int) + cast(1 + c_custkey % 30 < 3 as int) + cast(c_custkey % 31 < 2 as int)) + 1] risk_class from customer",
    "questionnaire_report": f"""with {RESP}, r as (select * from resp where respondent_id % 17 <> 0 or item_id <> 'q3'), c as (select respondent_id, cast(sum(score) as integer) total, case when count(*) = 5 then {band('sum(score)')} end category, string_agg(item_id || '=' || score, ',' order by item_id) breakdown from r group by 1)
select c.*, description from c left join (values {', '.join(f"('{name}', '{text}')" for name, text in rules.CATEGORY_TEXTS.items())}) t(name, description) on category = name""",
    "questionnaire": f"with {RESP}, r as (select * from resp where respondent_id % 17 <> 0 or item_id <> 'q3') select respondent_id, cast(sum(score) as integer) total, count(*) = 5 complete, case when count(*) = 5 then {band('sum(score)')} end category, max(score) filter (item_id = 'q1') q1 from r group by 1",
    "band_sensitivity": f"with {RESP} " + " union all ".join(f"select {s} shift, cast(count(*) filter ({band('total', s)} <> {band('total')}) as bigint) changed, count(*) n, round(count(*) filter ({band('total', s)} <> {band('total')}) / cast(count(*) as double), 6) share from tot" for s in (-2, -1, 1, 2)),
    "suitability": f"select cast(c_custkey as bigint) investor_id, {rating('r', 's')} rating, substr(case when r = '' then 'Missing Risk_Category' when s = '' then 'Missing Stock_Signal' when r = 'growth' then 'Invalid Risk_Category: must be one of' when s = 'Sell' then 'Invalid Stock_Signal: must be one of' end, 1, 24) error from (select c_custkey, ['Balanced', '', 'Growth', 'growth', 'Conservative', 'Aggressive'][c_custkey % 6 + 1] r, ['Buy', 'Hold', 'Avoid', '', 'Sell'][c_custkey % 5 + 1] s from customer)",
    "recommendations": f"with {RATED} select investor_id, ticker, rating, cast(rank as integer) rank, signal, {rnd('volatility')} from ranked",
    "recommendation_json": f"""with {SNAP} select ticker, '{{"ticker":"' || ticker || '","signal":"' || signal || '","suitability":{{"rating":"' || {rating("'Balanced'")} || '"}}}}' record from snap""",
    "best_picks": f"with {RATED} select investor_id, ticker, signal from rated where rating = 'Suitable' qualify row_number() over (partition by investor_id order by case when signal = 'Buy' then 0 else 1 end, volatility, position) = 1",
    "best_compared": f"with {RATED} select investor_id, arg_min(ticker, volatility) best from rated where ticker in ('Brand#1', 'Brand#7', 'Brand#12') and rating = 'Suitable' group by 1",
    "overview": f"with {RATED} select investor_id, count(*) filter (signal = 'Buy') n_buy, count(*) filter (signal = 'Hold') n_hold, count(*) filter (signal = 'Avoid') n_avoid, coalesce(string_agg(ticker, ',' order by position) filter (rating = 'Suitable'), '') suitable, coalesce(string_agg(ticker, ',' order by position) filter (rating = 'Use Caution'), '') caution, {rnd('avg(volatility) mean_volatility')}, case when count(*) filter (signal = 'Buy') > count(*) filter (signal = 'Avoid') then 'Bullish' when count(*) filter (signal = 'Buy') < count(*) filter (signal = 'Avoid') then 'Bearish' else 'Mixed' end sentiment from rated group by 1",
    "comparison": f"with {SNAP}, s as (select * from snap where ticker in ('Brand#1', 'Brand#7', 'Brand#12')) select arg_max(ticker, price_change_30d) better_momentum, arg_min(ticker, volatility) lower_volatility, case when count(*) filter (signal = 'Buy') = 1 then max(ticker) filter (signal = 'Buy') end stronger_outlook from s",
    "comparison_table": f"with {SNAP} " + " union all ".join(f"select '{m}' metric, round(max({m}) filter (ticker = 'Brand#1'), 6) brand_1, round(max({m}) filter (ticker = 'Brand#7'), 6) brand_7 from snap" for m in ("current_price", "price_change_30d", "rsi", "macd", "volatility")),
    "risk_bands": f"with {SNAP} select ticker, case when volatility < 1.5 then 'LOW' when volatility < 3 then 'MODERATE' else 'HIGH' end risk_level, case when rsi > 70 then 'overbought' when rsi < 30 then 'oversold' else 'neutral' end rsi_zone, case when price_change_30d <= -5 then 'down' when price_change_30d >= 10 then 'up' else 'flat' end trend_explained, case when price_change_30d < -5 then 'declining' when abs(price_change_30d) < 5 then 'flat' else 'uptrend' end trend_assessed from snap",
    "pros_cons": f"with {SNAP} select ticker, array_to_string(list_filter([case when signal = 'Buy' then 'buy signal' end, case when rsi < 30 then 'oversold' end, case when macd > 0 then 'upward momentum' end, case when price_change_30d > 5 then 'rising' end, case when volatility < 2 then 'stable' end, case when signal = 'Buy' then 'fits the profile' end], lambda x: x is not null), ', ') pros, array_to_string(list_filter([case when signal = 'Avoid' then 'avoid signal' end, case when rsi > 70 then 'overbought' end, case when macd <= 0 then 'downward momentum' end, case when price_change_30d < -5 then 'falling' end, case when volatility > 4 then 'volatile' end, case when signal = 'Avoid' then 'does not fit the profile' end], lambda x: x is not null), ', ') cons from snap",
    "info_cards": f"with {SNAP} select s.ticker, s.sector, x.ticker is not null analysed, {rnd('x.current_price current_price')}, x.signal signal, {rating(chr(39) + 'Growth' + chr(39), 'x.signal')} rating from stocks s left join (select * from snap where position % 3 <> 0) x on x.ticker = s.ticker",
    "ledger_trades": f"with {LEDGER} select ticker, window_id, entry_date, exit_date, {rnd('net_return')}, holding_days from trades",
    "ledger_points": f"with {LEDGER} select ticker, window_id, i, date, kind, {rnd('r')} from pts",
    "ledger_points_per_day": f"with {LEDGER} select a2.ticker, a2.window_id, a2.i, a2.date, pred kind, round(case when pred = 'Buy' then net_return when pred = 'Hold' and nc is not null then 0.5 * ((nc - \"close\") / \"close\" - 0.002) else 0.0 end, 6) r from a2 left join trades t on t.ticker = a2.ticker and t.window_id = a2.window_id and t.entry_i = a2.i and a2.starts where starts or (pred <> 'Buy' and not spent)",
    "equity_curve": f"with {LEDGER} select ticker, window_id, i, cast(seq as integer) seq, round(value, 4) as value from eq",
    "benchmark_curve": f"with {LEDGER} select ticker, window_id, round(value, 4) as value from bench",
    "window_results": f"with {LEDGER}, w as (select ticker, window_id, min(date) start, max(date) \"end\" from sig group by 1, 2), p as (select ticker, window_id, sum(r) * 100 rp, count(*) filter (kind = 'Buy') n_trades, count(*) filter (kind = 'Buy' and r > 0) n_wins from pts group by 1, 2) select ticker, window_id, start, \"end\", round(coalesce(rp, 0), 6) return_pct, coalesce(n_trades, 0) n_trades, coalesce(n_wins, 0) n_wins from w left join p using (ticker, window_id)",
    "backtest_metrics": f"with {LEDGER}, {CURVE} select ticker, n_changes, days, n_trades, n_wins, {rnd('final_value', 'total_return', 'sharpe', 'max_drawdown', 'benchmark_return', 'accuracy', 'annual_return', 'annual_benchmark', 'win_rate', 'excess_return')} from met",
    "backtest_summary": f"with {LEDGER}, {CURVE} select count(*) n_tickers, {rnd(*[f'avg({c}) mean_{c}' for c in ('total_return', 'annual_return', 'sharpe', 'max_drawdown', 'benchmark_return', 'annual_benchmark', 'excess_return', 'win_rate', 'accuracy', 'n_trades')], 'sum(n_wins)/cast(sum(n_trades)as(double)) pooled_win_rate').replace('as(double)', ' as double')}, count(*) filter (n_trades = 0) n_without_trades from met",
    "random_entry_odds": f"with {LEDGER}, q as (select distinct ticker, window_id, holding_days h from trades where holding_days > 0 and holding_days < n_rows), o as (select q.ticker, q.window_id, q.h, avg(case when (b.\"close\" - a.\"close\") / a.\"close\" - 0.002 > 0 then 1.0 else 0.0 end) w from q join sig a on a.ticker = q.ticker and a.window_id = q.window_id join sig b on b.ticker = q.ticker and b.window_id = q.window_id and b.i = a.i + q.h group by 1, 2, 3) select t.ticker, t.window_id, entry_date, holding_days, round(coalesce(w, 0), 6) win_odds from trades t left join o on o.ticker = t.ticker and o.window_id = t.window_id and o.h = t.holding_days",
    "combined_report": f"""with {LEDGER}, {CURVE}, p as (select ticker, seq, (value / first_value(value) over (partition by ticker order by seq) - 1) * 100 pct from eq), g as (select seq from unnest(range(1, (select max(seq) from p) + 1)) t(seq)), x as (select ticker, arg_max(pct, seq) last from p group by 1), y as (select g.seq, coalesce(p.pct, x.last) pct from g cross join x left join p on p.seq = g.seq and p.ticker = x.ticker), mc as (select seq, avg(pct) pct from y group by seq),
f as (select seq, pct, pct - max(pct) over (order by seq) fall, (100 + pct) / lag(100 + pct) over (order by seq) - 1 c from mc),
bc as (select ticker, row_number() over (partition by ticker order by window_id) seq, (value / first_value(value) over (partition by ticker order by window_id) - 1) * 100 pct from bench), bx as (select ticker, arg_max(pct, seq) last from bc group by 1), bl as (select avg(last) benchmark_curve_pct from bx),
t as (select arg_max(pct, seq) curve_pct, min(fall) drawdown_points, count(*) n_points, avg(c) / stddev_samp(c) sr, count(c) n from f),
m as (select avg(total_return) * 100 total_pct, avg(benchmark_return) * 100 benchmark_pct, sum(n_wins) / sum(n_trades) pooled_win_rate, cast(sum(n_trades) as bigint) n_trades from met)
select round(total_pct, 4) total_pct, round(curve_pct, 4) curve_pct, round(benchmark_curve_pct, 4) benchmark_curve_pct, round(drawdown_points, 4) drawdown_points, n_points, round(sr * sqrt(252), 4) sharpe, round((sr - 1.959963984540054 * sqrt((1 + sr * sr / 2) / n)) * sqrt(252), 4) lower,
  round((sr + 1.959963984540054 * sqrt((1 + sr * sr / 2) / n)) * sqrt(252), 4) upper, round(benchmark_pct, 4) benchmark_pct, round(total_pct - benchmark_pct, 4) excess_pct, round(pooled_win_rate, 4) pooled_win_rate, n_trades from t, m, bl""",
    "recommendation_records": f"""with {SNAP}, h as (select ticker, string_agg(strftime(date, '%Y-%m-%d'), ',' order by date) dates, cast(count(*) as integer) n_prices, round(sum("close"), 6) sum_prices from (select *, row_number() over (partition by ticker order by date desc) b from prices) where b <= 90 group by 1),
r as (select *, 'Balanced' risk from snap join h using (ticker)), x as (select *, {rating('risk')} rating from r)
select ticker, signal, rating, 'A ' || signal || ' signal is rated ' || rating || ' for the Balanced profile.' explanation, round(current_price, 2) current_price, round(price_change_30d, 2) price_change_30d, round(rsi, 1) rsi, round(macd, 2) macd, round(volatility, 2) volatility, dates, n_prices, sum_prices from x""",
    "mean_curve": f"with {LEDGER}, p as (select ticker, seq, (value / first_value(value) over (partition by ticker order by seq) - 1) * 100 pct from eq), g as (select seq from unnest(range(1, (select max(seq) from p) + 1)) t(seq)), x as (select ticker, arg_max(pct, seq) last from p group by 1), y as (select g.seq, coalesce(p.pct, x.last) pct from g cross join x left join p on p.seq = g.seq and p.ticker = x.ticker) select cast(seq as integer) seq, {rnd('avg(pct) pct')}, count(*) n_curves from y group by seq",
    "benchmark_mean_curve": f"with {LEDGER}, p as (select ticker, row_number() over (partition by ticker order by window_id) seq, (value / first_value(value) over (partition by ticker order by window_id) - 1) * 100 pct from bench), g as (select seq from unnest(range(1, (select max(seq) from p) + 1)) t(seq)), x as (select ticker, arg_max(pct, seq) last from p group by 1), y as (select g.seq, coalesce(p.pct, x.last) pct from g cross join x left join p on p.seq = g.seq and p.ticker = x.ticker) select cast(seq as integer) seq, {rnd('avg(pct) pct')}, count(*) n_curves from y group by seq",
    "bootstrap_mean": f"""with {IND}, h as ({drawn('(select ticker, date, fwd_return from lab)', _ROW, 42, 'rep', ', range(10000) z(rep)')}),
v as (select rep, sum(({_EDGES}) * fwd_return) / sum({_EDGES}) as value from h group by rep)
select (select round(avg(fwd_return), 6) from lab) estimate, round(quantile_cont(value, 0.025), 6) lower, round(quantile_cont(value, 0.975), 6) upper, count(*) resamples from v""",
    "naive_baselines": f"""with {_BASES}, h as ({drawn('c', _ROW, 42, 'i')}),
pred as (select ticker, date, target y_true, 'majority' model, major y_pred from h, t where i = 0 union all {_bases('h')}),
{report('model')} select model, n_test, {rnd('accuracy', 'balanced_accuracy', 'precision_weighted', 'recall_weighted', 'f1_weighted', 'f1_macro')} from sc""",
    "seed_stability": f"""with {_BASES}, {', '.join(f"h{k} as ({drawn('c', _ROW, k, 'i')})" for k in range(1, 6))},
pred as ({' union all '.join(f"select *, {k} seed from ({_bases(f'h{k}')})" for k in range(1, 6))}),
{report('model, seed')} select model, {rnd('avg(accuracy) accuracy_mean', 'min(accuracy) accuracy_min', 'max(accuracy) accuracy_max', 'avg(f1_macro) f1_macro_mean', 'min(f1_macro) f1_macro_min', 'max(f1_macro) f1_macro_max')} from sc group by 1""",
    "model_round_trip": f"with {_BASES} select count(*) n_test, true same from lab, m where date >= sd",
    "holding_days": f"with {LEDGER} select ticker, {rnd('quantile_cont(holding_days, 0.5) median_days', 'avg(holding_days) mean_days')}, count(*) n_trades from trades group by 1",
    "win_intervals": f"with {LEDGER}, c as (select ticker, count(*) filter (net_return > 0) k, count(*) n from trades group by 1) select ticker, k, n, round({_W[0]}, 6) estimate, round({_W[1]}, 6) lower, round({_W[2]}, 6) upper, round({_W[2]} - {_W[1]}, 6) width, 0.5 < {_W[1]} or 0.5 > {_W[2]} excludes_half from c",
    "chance_matched": f"with {LEDGER}, q as (select distinct ticker, window_id, holding_days h from trades where holding_days > 0 and holding_days < n_rows), o as (select q.ticker, q.window_id, q.h, avg(case when (b.\"close\" - a.\"close\") / a.\"close\" - 0.002 > 0 then 1.0 else 0.0 end) w from q join sig a on a.ticker = q.ticker and a.window_id = q.window_id join sig b on b.ticker = q.ticker and b.window_id = q.window_id and b.i = a.i + q.h group by 1, 2, 3), t as (select t.ticker, net_return, coalesce(w, 0) p from trades t left join o on o.ticker = t.ticker and o.window_id = t.window_id and o.h = t.holding_days) select ticker, cast(count(*) filter (net_return > 0) as bigint) k, count(*) n, round(sum(p), 6) expected, round(case when sum(p * (1 - p)) > 0 then (count(*) filter (net_return > 0) - sum(p)) / sqrt(sum(p * (1 - p))) end, 6) z from t group by 1",
    "mcnemar": f"with {PRED}, c as (select a.model a, b.model b, count(*) filter (a.y_pred = a.y_true and b.y_pred <> b.y_true) only_a, count(*) filter (a.y_pred <> a.y_true and b.y_pred = b.y_true) only_b from pred a join pred b using (ticker, date) where a.model < b.model group by 1, 2) select a, b, only_a, only_b, round(case when only_a + only_b >= 25 then power(abs(only_a - only_b) - 1, 2) / (only_a + only_b) end, 6) statistic, case when only_a > only_b then a when only_b > only_a then b end leader from c",
    "anova": f"with {IND}, {STOCKS}, g as (select target, sector, count(*) n, avg(daily_return) m, var_samp(daily_return) v from lab join stocks using (ticker) group by 1, 2), t as (select target, count(*) k, sum(n) n, sum(n * m) s, sum(n * m * m) ss, sum((n - 1) * v) w from g group by 1) select target, k, cast(n as bigint) n, round(((ss - s * s / n) / (k - 1)) / (w / (n - k)), 6) f from t",
    "kruskal": "with e as (select event_type, round(cast(value as double), 1) v from events where value is not null), r as (select event_type, v, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 r, count(*) over (partition by v) t from e), g as (select event_type, sum(r) s, count(*) n from r group by 1), x as (select count(*) k, cast(sum(n) as double) n, sum(s * s / n) q from g), c as (select sum(cast(t as double) * t - 1) ties from r) select k, cast(n as bigint) n, round((q * 12 / (n * (n + 1)) - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 6) h from x, c",
    "tukey": f"with {IND}, {STOCKS}, g as (select sector, count(*) n, avg(fwd_return) m, var_samp(fwd_return) v from lab join stocks using (ticker) group by 1), p as (select sum((n - 1) * v) / (sum(n) - count(*)) mse from g) select a.sector a, b.sector b, round(a.m - b.m, 6) difference, round(abs(a.m - b.m) / sqrt(mse / 2 * (1.0 / a.n + 1.0 / b.n)), 6) q from g a join g b on a.sector < b.sector, p",
    "sharpe_intervals": f"with {IND}, s as (select ticker, count(daily_return) n, avg(daily_return) / stddev_samp(daily_return) sr from ind group by 1) select ticker, n, {rnd('sr*sqrt(252) sharpe', '(sr-1.959963984540054*sqrt((1+sr*sr/2)/n))*sqrt(252) lower', '(sr+1.959963984540054*sqrt((1+sr*sr/2)/n))*sqrt(252) upper')} from s",
    "mean_return_tests": f"with {IND} select ticker, count(daily_return) n, {rnd('avg(daily_return) mean', 'stddev_samp(daily_return) sd', 'avg(daily_return)/(stddev_samp(daily_return)/sqrt(count(daily_return))) t')} from ind group by 1",
    "paired_return_tests": f"with {IND}, d as (select a.ticker, a.daily_return - b.daily_return x from ind a join ind b using (date) where a.ticker <> 'Brand#1' and b.ticker = 'Brand#1') select ticker, count(x) n, {rnd('avg(x) mean', 'avg(x)/(stddev_samp(x)/sqrt(count(x))) t')} from d group by 1",
    "sample_sizes": f"with {LEDGER}, c as (select ticker, avg(case when net_return > 0 then 1.0 else 0.0 end) p from trades group by 1), e as (select *, greatest(0.05, least(0.95, p)) q from c) select ticker, round(p, 6) p, cast(ceil(power(1.959963984540054 + 0.8416212335729143, 2) * q * (1 - q) / power(q - 0.5001, 2)) as bigint) needed from e",
    "cronbach": f"with {RESP}, v as (select respondent_id % 5 cohort, item_id, var_samp(score) v from resp group by 1, 2), iv as (select cohort, sum(v) item_variance from v group by 1), t as (select respondent_id % 5 cohort, count(*) n, var_samp(total) total_variance from tot group by 1), a as (select *, (1 - item_variance / total_variance) * 5 / 4 alpha from t join iv using (cohort)) select cohort, n, {rnd('total_variance', 'item_variance', 'alpha')}, case when alpha >= 0.9 then 'excellent' when alpha >= 0.8 then 'good' when alpha >= 0.7 then 'acceptable' when alpha >= 0.6 then 'questionable' when alpha >= 0.5 then 'poor' else 'unacceptable' end label from a",
    "item_analysis": f"with {RESP}, x as (select item_id item, score, total - score rest from resp join tot using (respondent_id)), v as (select item, avg(score) mean, stddev_samp(score) sd, var_samp(score) vs, var_samp(rest) vr, corr(score, rest) r from x group by 1), s as (select sum(vs) tv from v) select item, {rnd('mean', 'sd', 'r item_rest', '(1-(tv-vs)/vr)*4/3 alpha_without')}, r < 0.3 weak from v, s",
    "listed_intents": f"with {LISTED} select message_id, tickers, intent from intent",
    "response_matrices": """with {RESP}, w as (select respondent_id, case when respondent_id = 7 then 9 else respondent_id % 5 end cohort, list(case when respondent_id % 5 = 3 and respondent_id <> 7 then 2 when item_id = 'q2' and respondent_id % 20 = 0 then 5 else score end) q from resp group by 1, 2),
c as (select cohort, count(*) n, count(*) filter (len(list_filter(q, lambda x: x not between 1 and 4)) > 0) n_bad, var_samp(list_sum(q)) v from w group by 1)
select cohort, n, n_bad, array_to_string(list_filter([case when n_bad > 0 then n_bad || ' respondents with invalid answers' end, case when n < 2 then 'needs at least two respondents' end, case when coalesce(v, 0) <= 0 then 'totals have no variance' end], lambda x: x is not null), '; ') errors from c""".replace("{RESP}", RESP),
    "message_intents": f"with {INTENT} select message_id, tickers, intent from intent",
    "message_gate": f"with {INTENT} select message_id, intent, case when message_id % 2 = 0 then 'Balanced' end risk_category, intent not in ('best_pick', 'portfolio_overview', 'explain_recommendation') or message_id % 2 = 0 answerable from intent",
    "guard_verdicts": f"with {GUARD} select summary_id, contradicts, accepted from verdicts",
    "guard_performance": f"with {GUARD}, c as (select count(*) filter (contradicts and not accepted) tp, count(*) filter (not contradicts and not accepted) fp, count(*) filter (not contradicts and accepted) tn, count(*) filter (contradicts and accepted) fn from verdicts) select tp, fp, tn, fn, 1.0 \"precision\", 1.0 recall, 1.0 accuracy, 0.0 false_accept_rate, 0.0 false_reject_rate, 1.0 f1, round({_G[1]}, 6) recall_lower, round({_G[2]}, 6) recall_upper from c",
    "kpss_tests": f"""with {IND}, cells as (select ticker, 'close_price' feature, date, close_price x from feat union all select ticker, 'daily_return', date, daily_return from feat union all select ticker, 'rsi', date, rsi from feat),
num as (select *, row_number() over (partition by ticker, feature order by date) - 1 t, count(*) over v n, avg(x) over v mean, min(x) over v lo, max(x) over v hi from cells where x is not null and isfinite(x) window v as (partition by ticker, feature)),
e as materialized (select ticker, feature, t, n, x - mean e, sum(x - mean) over (partition by ticker, feature order by t) s from num where n >= 20 and hi > lo),
near as (select a.ticker, a.feature, i, any_value(a.n) n, sum(a.e * b.e) g from (select *, unnest(range(0, cast(ceil(power(n, 2 / 9)) as bigint) + 1)) i from e) a join e b on b.ticker = a.ticker and b.feature = a.feature and b.t = a.t - i group by 1, 2, 3),
m as (select ticker, feature, n, sum(case when i > 0 then i * g * 2 / n end) s1, sum(case when i > 0 then g * 2 / n else g / n end) s0 from near group by 1, 2, 3),
l as (select ticker, feature, case when s0 = 0 then 0 else least(n - 1, cast(floor(1.1447 * power(power(s1 / s0, 2), 1 / 3) * power(n, 1 / 3)) as bigint)) end lags from m),
lr as (select a.ticker, a.feature, sum(case when i = 0 then 1 else 2 * (1 - i / (lags + 1)) end * a.e * b.e) v from (select *, unnest(range(0, lags + 1)) i from e join l using (ticker, feature)) a join e b on b.ticker = a.ticker and b.feature = a.feature and b.t = a.t - i group by 1, 2),
k as (select ticker, feature, cast(n as integer) n_obs, cast(any_value(lags) as integer) kpss_lags, sum(s * s) / n / any_value(v) kpss from e join l using (ticker, feature) join lr using (ticker, feature) group by ticker, feature, n),
p as (select *, case when kpss <= 0.347 then 0.1 when kpss <= 0.463 then 0.1 - (kpss - 0.347) / 0.116 * 0.05 when kpss <= 0.574 then 0.05 - (kpss - 0.463) / 0.111 * 0.025 when kpss <= 0.739 then 0.025 - (kpss - 0.574) / 0.165 * 0.015 else 0.01 end::double kpss_p from k)
select ticker, feature, n_obs, {rnd('kpss', 'kpss_p')}, kpss_lags, kpss_p > 0.05 kpss_stationary from p""",
    "threshold_sweep": f"with {IND}, x as (select th threshold, case when fwd_return > th then 'Buy' when fwd_return >= 0 then 'Hold' else 'Avoid' end label from lab, (values (0.05::double), (0.075::double), (0.1::double), (0.15::double)) t(th)) select threshold, label, count(*) n, round(count(*) / sum(count(*)) over (partition by threshold), 6) share from x group by threshold, label",
    "universe_comparison": f"with {PRED.replace('pred as', 'pred0 as')}, {STOCKS}, pred as (select 'all' universe, pred0.* from pred0 union all select 'five', pred0.* from pred0 join stocks using (ticker) where position <= 5), {report('universe, model')} select universe, model, n_test, {rnd('accuracy', 'f1_weighted')} from sc",
    "regime_accuracy": f"with {PRED}, g(regime, a, b) as (values ('first', date '1995-01-01', date '1996-12-31'), ('second', date '1997-01-01', date '1998-06-30'), ('third', date '1998-07-01', date '1999-12-31'), ('fourth', date '2000-01-01', date '2001-12-31')), c as (select model, regime, count(*) filter (y_true = y_pred) k, count(*) n from pred join g on date between a and b group by 1, 2) select model, regime, k, n, round({_W[0]}, 6) accuracy, round({_W[1]}, 6) lower, round({_W[2]}, 6) upper from c",
    "inference_table": f"with {LEDGER}, {CURVE}, s as (select ticker, avg(c) / stddev_samp(c) sr, count(c) n from cv group by 1) select ticker, n_trades, n_wins, {rnd('win_rate', 'total_return', 'benchmark_return', 'excess_return', 'sr*sqrt(252) sharpe', '(sr-1.959963984540054*sqrt((1+sr*sr/2)/n))*sqrt(252) lower', '(sr+1.959963984540054*sqrt((1+sr*sr/2)/n))*sqrt(252) upper')} from met join s using (ticker)",
}

SQL["interval_signs"] = f"select count(*) filter (lower > 0) n_above, count(*) filter (upper < 0) n_below, count(*) filter (lower <= 0 and upper >= 0) n_including, count(*) filter (lower is null or upper is null) n_undefined from ({SQL['inference_table']})"

_DATES = {
    "date": "required_columns stored_periods stratified_split blocked_panel blocked_sequences price_panel price_scan price_normalised sanitised daily_returns moving_averages gains_losses ema rsi_macd features labelled_panel sequence_windows latest_features rebased_prices drawdowns date_positions ledger_points ledger_points_per_day",
    "first": "purged_split row_cut_split walk_forward trailing_validation",
    "last": "purged_split row_cut_split walk_forward regime_split",
    "start": "window_results",
    "end": "window_results",
    "entry_date": "ledger_trades random_entry_odds",
    "exit_date": "ledger_trades",
}
for _column, _names in _DATES.items():
    for _name in _names.split():
        SQL[_name] = f'select * replace (cast("{_column}" as varchar) as "{_column}") from ({SQL[_name]})'
