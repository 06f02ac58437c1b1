"""DuckDB SQL that gives the same rows as the queries of the same name.

Where a query parses text, the SQL takes the values from the table columns the
text was rendered from, and never parses.
"""

from __future__ import annotations

from logweir.plans.answers import PLAIN_PROMPT, SEARCH_PROMPT
from logweir.registry.queries import INGEST, ORDER_QUERIES, ORDER_TOKENS, WORD_TOKENS
from logweir.schema import ABBREVIATIONS

ORACLES: dict[str, str] = {}

_UUID = (
    "regexp_replace(md5(cast(o_orderkey as varchar)), "
    r"'^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5')"
)
_TS = "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"
_INDEX_TS = "strftime({}, '%Y-%m-%dT%H:%M:%S.%g') || '+0000'"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Order records as parsing gives them, from the columns of the table.
_ORDERS = f"""
select o_orderkey as log_id, o_orderdate as ts,
  'Order ORD' || lpad(o_orderkey::varchar, 6, '0') || ' is ' || o_orderpriority as message,
  case o_orderkey % 4 when 0 then 'order-service' when 1 then 'payment-service'
    when 2 then 'inventory-service' else 'shipping-service' end as source,
  case o_orderkey % 3 when 0 then 'INFO' when 1 then 'ERROR' else 'WARNING' end as level,
  {_UUID} as trace_id,
  'ORD' || lpad(o_orderkey::varchar, 6, '0') as order_number,
  'CUST' || lpad(o_custkey::varchar, 6, '0') as customer_id,
  case o_orderstatus when 'P' then 'PLACED' when 'F' then 'SHIPPED' else 'ON_HOLD' end as order_status,
  o_totalprice::decimal(12,2)::varchar as amount,
  '[{{product=Part ' || (o_custkey % 50) || ',qty=' || (o_orderkey % 5 + 1) || ',price=9.99}}]' as order_lines,
  case when o_orderstatus = 'O' then 'Payment Declined' end as hold_reason
from orders
"""

_EVENTS = """
select event_id as log_id, ts, event_type as source,
  case event_id % 3 when 0 then 'INFO' when 1 then 'ERROR' else 'WARNING' end as level,
  'user ' || user_id || ' did ' || event_type as message, value as anomaly_score, user_id
from events
"""

ORACLES["parse_log4j2"] = f"""
select log_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, message, source, level, trace_id,
  order_number, customer_id, order_status, amount, order_lines, hold_reason
from ({_ORDERS})
"""

ORACLES["parse_mixed_formats"] = f"""
select event_id as log_id,
  case event_id % 6 when 0 then 'log4j2' when 1 then 'json' when 2 then 'syslog'
    when 3 then 'access' when 4 then 'key_value' else 'plain' end as format,
  case when event_id % 6 in (0, 1) then strftime(ts, '%Y-%m-%d %H:%M:%S') else '{INGEST}' end as ts,
  event_id % 6 not in (0, 1) as ts_defaulted,
  case event_id % 6 when 0 then 'user ' || user_id || ' did ' || event_type
    when 1 then 'json ' || event_type when 2 then 'user ' || user_id || ' did ' || event_type
    when 5 then 'plain note ' || event_type || ' number ' || event_id else '' end as message,
  case event_id % 6 when 0 then 'web-' || event_type when 1 then event_type
    when 2 then event_type || 'd' else 'events.log' end as source,
  case event_id % 6 when 1 then 'ERROR' else 'INFO' end as level,
  case when event_id % 6 in (0, 1, 4) then 'u' || user_id end as customer_id,
  case event_id % 6 when 3 then case when event_type = 'error' then '500' else '200' end
    when 4 then event_type end as order_status,
  case when event_id % 6 = 1
    then '[{{"product_id":"s' || (event_id % 7) || '","quantity":2}}]' end as order_lines,
  case when event_id % 6 = 4 then 'UPS' end as shipping_provider,
  case when event_id % 6 = 2 then 'host' || (user_id % 4) end as host,
  case when event_id % 6 = 3 then '10.0.0.' || (user_id % 250) end as ip,
  case when event_id % 6 = 3 then 'GET /' || event_type || ' HTTP/1.1' end as request,
  case when event_id % 6 = 3 then (event_id % 5000)::varchar end as size
from events
"""

ORACLES["parse_bad_records"] = """
with lines as (
  select event_id, case event_id % 3
    when 0 then '{"svc": "' || event_type || '", "details": ' || user_id || '}'
    when 1 then '{"svc": "' || event_type || '", "details": null, "n": ' || user_id || '}'
    else '{"svc": "' || event_type || '", "details": "cut off' end as line
  from events)
select event_id as log_id,
  case when event_id % 3 = 2 then 'plain' else 'error' end as format,
  case when event_id % 3 = 2 then 'INFO' else 'ERROR' end as level,
  'bad.log' as source, line as message,
  case when event_id % 3 = 2 then null else line end as semantic_template
from lines
"""

ORACLES["parse_prefix_split"] = """
select event_id as log_id,
  case when event_id % 4 in (0, 1) then strftime(ts, '%Y-%m-%d %H:%M:%S.%g') end as ts,
  case event_id % 4 when 0 then 'ERROR' when 1 then 'NOTE' when 2 then 'WARNING'
    else case when event_type = 'error' then 'ERROR' else 'INFO' end end as level,
  case event_id % 4 when 0 then event_type || ' of ' || user_id when 1 then event_type
    when 2 then event_type || ' of ' || user_id
    else case when event_type = 'error' then '' else 'nothing special about ' || event_type end end as message
from events
"""

ORACLES["parse_format_string"] = """
with e as (select *, event_id % 10 <> 9 as fits from events)
select event_id as log_id, fits,
  case when fits then strftime(ts, '%Y-%m-%d') end as day,
  case when fits then strftime(ts, '%H:%M:%S') end as clock,
  case when fits then 'WARN' end as level,
  case when fits then event_type end as component,
  case when fits then 'user <num> took <num> ms' end as content,
  case when fits then 5::bigint end as tokens
from e
"""

ORACLES["index_timestamps"] = f"""
select event_id, {_INDEX_TS.format('ts')} as from_time,
  case event_id % 3 when 0 then {_INDEX_TS.format('ts')}
    when 1 then strftime(ts, '%Y-%m-%dT%H:%M:%S.000+0000')
    else '2030-01-01T00:00:00.000+0000' end as from_text
from events
"""

_abbreviated = (
    "'DB conn err for usr ' || user_id || ': Req ' || event_id || ' resp ' || event_type || "
    "' subdb msg=temp_1, dest-src QA ADD'"
)
for _short, _long in ABBREVIATIONS.items():
    _abbreviated = rf"regexp_replace({_abbreviated}, '(?i)\b{_short}\b', '{_long}', 'g')"
ORACLES["expand_abbreviation_words"] = f"select event_id, {_abbreviated} as line from events"

ORACLES["scan_log_files"] = f"""
select 64::bigint as id_length, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, order_number, level,
  source, message
from ({_ORDERS})
"""

ORACLES["recent_logs"] = f"""
select log_id, {_INDEX_TS.format('e.ts')} as ts, source, message from ({_EVENTS}) e
order by e.ts desc, log_id limit 100
"""

ORACLES["recent_messages"] = f"""
select log_id, message from ({_EVENTS}) e order by e.ts desc, log_id limit 10
"""

ORACLES["anomalies_above"] = f"""
select log_id, source, anomaly_score from ({_EVENTS}) e
where anomaly_score >= 150 order by e.ts desc, log_id limit 100
"""

ORACLES["anomaly_report"] = f"""
with top as (
  select *, row_number() over (order by ts desc, log_id) as rank
  from ({_EVENTS}) where anomaly_score >= 150 qualify rank <= 5)
select case when count(*) = 0 then 'No anomalies detected.' else
  'Found ' || count(*) || ' anomalies in the logs:' || chr(10) || chr(10) ||
  string_agg(printf('%d. [%s] %s' || chr(10) || '   Score: %.4f, Source: %s' || chr(10) ||
    '   Timestamp: %s' || chr(10), rank, level, message, anomaly_score, source,
    {_INDEX_TS.format('ts')}), chr(10) order by rank) end as report
from top
"""

ORACLES["date_range_logs"] = f"""
select log_id, {_INDEX_TS.format('e.ts')} as ts, source from ({_EVENTS}) e
where e.ts between timestamp '2024-01-10 06:00:00' and timestamp '2024-01-12 00:00:00'
order by e.ts desc, log_id limit 100
"""

ORACLES["info_last_24h"] = f"""
select log_id, source, level from ({_EVENTS}) e
where level = 'INFO' and e.ts between timestamp '2024-01-19 00:00:00' and timestamp '2024-01-20 00:00:00'
"""

ORACLES["logs_per_source"] = """
select case event_id % 6 when 0 then 'web-' || event_type when 1 then event_type
    when 2 then event_type || 'd' else 'events.log' end as source, count(*) as count
from events group by 1 order by count desc, source limit 10
"""

ORACLES["top_hits_per_source"] = f"""
select source, row_number() over (partition by source order by ts desc, log_id) as rank, log_id, message
from ({_EVENTS}) qualify rank <= 5
"""

ORACLES["context_messages"] = f"""
with recent as (
  select * from ({_EVENTS}) e where level = 'INFO'
    and e.ts between timestamp '2024-01-19 00:00:00' and timestamp '2024-01-20 00:00:00'),
largest as (select source from recent group by source order by count(*) desc, source limit 3)
select source, row_number() over (partition by source order by ts desc, log_id) as rank, log_id, message
from recent where source in (select source from largest) qualify rank <= 20
"""

ORACLES["bucket_mean_5m"] = """
with means as (
  select time_bucket(interval '5 minutes', ts) as bucket, avg(value) as mean, count(*) as count
  from events group by 1),
flagged as (
  select m.bucket, m.mean, m.count, count(p.mean) as past_buckets, avg(p.mean) as past_mean,
    stddev_samp(p.mean) as past_stddev
  from means m left join means p
    on p.bucket < m.bucket and p.bucket >= m.bucket - interval '60 minutes'
  group by all)
select strftime(bucket, '%Y-%m-%d %H:%M:%S') as ts, round(mean, 9) as mean, count,
  past_buckets, round(past_mean, 9) as past_mean,
  coalesce(abs(mean - past_mean) > 3 * past_stddev, false) as anomalous
from flagged
"""

ORACLES["bucket_mean_stream"] = """
select strftime(time_bucket(interval '5 minutes', events.ts), '%Y-%m-%d %H:%M:%S') as ts,
  round(avg(value), 9) as mean, count(*) as count
from events group by 1
"""

ORACLES["bucket_mean_append"] = """
with seen as (
  select ts, value, time_bucket(interval '5 minutes', ts) as bucket,
    coalesce(ts < timestamp '2024-01-16' and event_type <> 'error', false) as early
  from events where ts is not null),
closed as (
  select max(ts) filter (where early) - interval '10 minutes' as first_cut,
    max(ts) - interval '10 minutes' as last_cut
  from seen)
select strftime(bucket, '%Y-%m-%d %H:%M:%S') as ts, round(avg(value), 9) as mean, count(*) as count
from seen, closed
where (early or bucket + interval '5 minutes' > first_cut)
  and bucket + interval '5 minutes' <= last_cut
group by bucket
"""

ORACLES["query_understanding"] = rf"""
with asked as (
  select o_orderkey as query_id, 'why did ORD' || o_orderkey || ' of cust' || o_custkey ||
    ' fail after ' || strftime(o_orderdate, '%Y%m%d') || ' or ' || strftime(o_orderdate, '%Y-%m-%d') ||
    '? see ' || {_UUID} || ' ' || o_orderpriority as query from orders),
found as (
  select query_id, regexp_extract_all(query, '(?i)([a-f0-9\-]{{36}}|ORD\d+|CUST\d+|\w{{6,}})') as tokens
  from asked)
select query_id, array_to_string(tokens, '|') as tokens,
  strftime(strptime(list_filter(tokens, lambda t: regexp_full_match(t, '\d{{8}}'))[1], '%Y%m%d'),
    '%Y-%m-%d %H:%M:%S') as lo,
  strftime(strptime(list_filter(tokens, lambda t: regexp_full_match(t, '\d{{8}}'))[1], '%Y%m%d'),
    '%Y-%m-%d %H:%M:%S') as hi
from found
"""

_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


def _tokens_cte(rows: list[tuple]) -> str:
    """``tok(query_id, token_no, token, lo, hi, words)`` of literal tokens."""
    values = ", ".join(
        f"({r[0]}::bigint, {r[1]}, {_q(r[2])}, "
        + (f"timestamp '{r[3]}', timestamp '{r[4]}')" if len(r) > 3 else "null::timestamp, null::timestamp)")
        for r in rows
    )
    return (
        f"tok as (select *, {_WORDS.format('token')} as words "
        f"from (values {values}) v(query_id, token_no, token, lo, hi))"
    )


def _bm25_ctes(texts: str, keywords: str | None) -> str:
    """``scores(query_id, log_id, score)``; ``texts`` and ``keywords`` select the fields."""
    ctes = f"""
texts as (select * from ({texts}) where words is not null),
sizes as (select field, count(*) as docs, avg(len(words)) as mean_length from texts group by field),
asked_words as (select distinct unnest(words) as word from tok),
df as (select field, word, count(*) as df from texts, asked_words
  where list_contains(words, word) group by all),
idf as (select field, word, ln(1 + (docs - df + 0.5) / (df + 0.5)) as idf from df join sizes using (field)),
token_idf as (
  select query_id, token_no, field, sum(idf) as idf
  from (select query_id, token_no, len(words) as n, unnest(words) as word from tok) join idf using (word)
  group by query_id, token_no, field, n having count(*) = n),
tf as (
  select query_id, token_no, t.field, log_id, len(t.words) as length,
    len(list_filter(range(1, len(t.words) - len(q.words) + 2),
      lambda i: t.words[i : i + len(q.words) - 1] = q.words)) as tf
  from texts t join tok q on len(q.words) > 0 and list_contains(t.words, q.words[1])
  where (q.lo is null or t.ts >= q.lo) and (q.hi is null or t.ts <= q.hi)),
text_hits as (
  select query_id, token_no, log_id,
    idf * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean_length)) as score
  from tf join token_idf using (query_id, token_no, field) join sizes using (field) where tf > 0)"""
    union = "select * from text_hits"
    if keywords:
        ctes += f""",
keys as (select * from ({keywords}) where token is not null),
key_all as (
  select q.query_id, q.token_no, k.field, k.log_id, k.ts, q.lo, q.hi,
    count(*) over (partition by q.query_id, q.token_no, k.field) as df
  from keys k join tok q on k.token = q.token),
key_hits as (
  select query_id, token_no, log_id, ln(1 + (docs - df + 0.5) / (df + 0.5)) / 2.2 as score
  from key_all join (select field, count(*) as docs from keys group by field) using (field)
  where (lo is null or ts >= lo) and (hi is null or ts <= hi))"""
        union += " union all select * from key_hits"
    return (
        ctes
        + f""",
scores as (
  select query_id, log_id, round(sum(score), 9) as score
  from (select query_id, token_no, log_id, max(score) as score from ({union}) group by all)
  group by query_id, log_id)"""
    )


_ORDER_TEXTS = (
    f"select log_id, ts, 'message' as field, {_WORDS.format('message')} as words from o "
    f"union all select log_id, ts, 'customer_id', {_WORDS.format('customer_id')} from o"
)
_ORDER_KEYS = (
    "select log_id, ts, 'trace_id' as field, trace_id as token from o "
    "union all select log_id, ts, 'order_number', order_number from o"
)

ORACLES["phrase_any_token"] = f"""
with o as ({_ORDERS}), {_tokens_cte(ORDER_TOKENS)}, {_bm25_ctes(_ORDER_TEXTS, _ORDER_KEYS)}
select query_id, log_id from scores
"""

ORACLES["lexical_bm25"] = f"""
with {_tokens_cte(WORD_TOKENS)},
{_bm25_ctes(f"select doc_id as log_id, null::timestamp as ts, 'message' as field, {_WORDS.format('text')} as words from documents", None)}
select query_id, row_number() over (partition by query_id order by score desc, log_id) as rank,
  log_id, round(score, 6) as score
from scores qualify rank <= 20
"""

ORACLES["indexed_phrases"] = ORACLES["phrase_any_token"]

ORACLES["indexed_bm25"] = ORACLES["lexical_bm25"]

ORACLES["hash_embeddings"] = """
with codes as (
  select conv_id, turn, text, range(0, 384) as cells,
    list_transform(regexp_extract_all(coalesce(text, ''), '(?s).'), lambda c: unicode(c)) as codes
  from conversations),
cells as (
  select conv_id, turn, list_transform(cells, lambda k: coalesce(list_sum(
    list_transform(range(k, len(codes), 384), lambda i: codes[i + 1] / 255.0)), 0.0::double)) as v
  from codes),
sized as (select conv_id, turn, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as size from cells)
select conv_id, turn, size = 0 as zero, unnest(range(0, 384)) as cell,
  round(unnest(v) / case when size > 0 then size else 1 end, 6) as value
from sized
"""

_VECTORS = """
logs as (
  select vec_id as log_id, embedding::double[] as v,
    timestamp '2024-01-01' + to_hours(vec_id::int) as ts from embeddings),
means as (
  select label::bigint as query_id, list(value order by pos) as qv from (
    select label, pos, avg(x) as value from (
      select label, unnest(embedding)::double as x, unnest(range(0, len(embedding))) as pos from embeddings)
    group by label, pos) group by label)
"""

ORACLES["vector_topk"] = f"""
with {_VECTORS},
scored as (
  select query_id, log_id, round(list_cosine_similarity(v, qv) + 1, 9) as score from logs, means
  where list_sum(list_transform(v, lambda x: x * x)) > 0)
select query_id, row_number() over (partition by query_id order by score desc, log_id) as rank,
  log_id, round(score, 6) as score
from scored qualify rank <= 10
"""

ORACLES["vector_topk_dated"] = f"""
with {_VECTORS},
scored as (
  select query_id, log_id, round(list_cosine_similarity(v, qv) + 1, 9) as score from logs, means
  where list_sum(list_transform(v, lambda x: x * x)) > 0
    and ts between timestamp '2024-01-02' + to_hours(query_id::int)
    and timestamp '2024-01-02' + to_hours(query_id::int) + interval '5 days')
select query_id, row_number() over (partition by query_id order by score desc, log_id) as rank,
  log_id, round(score, 6) as score
from scored qualify rank <= 10
"""


def _embedded(name: str, source: str, key: str, text: str) -> str:
    """CTE of unit character vectors as rows ``(key, cell, x)``, in single precision."""
    return f"""
{name}_cells as (
  select {key}, (pos % 384) as cell, sum(code / 255.0) as x from (
    select {key}, unnest(list_transform(regexp_extract_all({text}, '(?s).'), lambda c: unicode(c))) as code,
      unnest(range(0, length({text}))) as pos from {source})
  group by all),
{name} as (
  select {key}, cell, (x / sqrt(sum(x * x) over (partition by {key})))::float::double as x
  from {name}_cells)"""


def _near(k: int, condition: str = "true") -> str:
    """CTE ``near(query_id, log_id, score, pos)``: ``k`` best cosines + 1 per query."""
    return f"""
dots as (
  select query_id, log_id, sum(e.x * q.x) as dot from e join qe q using (cell) group by all),
norms as (select log_id, sqrt(sum(x * x)) as n from e group by log_id),
qnorms as (select query_id, sqrt(sum(x * x)) as n from qe group by query_id),
cosines as (
  select q.query_id, l.log_id, round(coalesce(d.dot, 0) / l.n / q.n + 1, 9) as score
  from qnorms q cross join norms l left join dots d using (query_id, log_id)
    join o using (log_id) join asked a using (query_id) where {condition}),
near as (
  select query_id, log_id, score, row_number() over (partition by query_id order by score desc, log_id) as pos
  from cosines qualify pos <= {k})"""


def _lexical(k: int) -> str:
    return f"""
words as (
  select query_id, log_id, score, row_number() over (partition by query_id order by score desc, log_id) as pos
  from scores qualify pos <= {k})"""


_ORDER_QUERY_TOKENS = [
    (1, 0, "happened"),
    (1, 1, "ORD000123"),
    (2, 0, "urgent"),
    (2, 1, "orders"),
    (2, 2, "CUST000037"),
    (2, 3, "please"),
    (3, 0, "a1d0c6e8-3f02-7327-d846-1063f4ac58a6"),
    (5, 0, "specified", "1998-01-01", "1998-01-01"),
    (5, 1, "19980101", "1998-01-01", "1998-01-01"),
]
_NO_RANGE = [row[:3] for row in _ORDER_QUERY_TOKENS]


def _asked(rows: list[tuple]) -> str:
    values = ", ".join(f"({r[0]}::bigint, {_q(r[1])})" for r in rows)
    return f"asked as (select * from (values {values}) v(query_id, query))"


_CONTENT = (
    "concat_ws('|', ts, message, source, level, trace_id, order_number, customer_id, "
    "order_status, amount, order_lines, hold_reason)"
)


def _merged(k: int, first: str, cut: int | None = None) -> str:
    """CTE ``hits``: union by log, optional cut, then one row per content."""
    cut_sql = f"qualify row_number() over (partition by query_id order by pos) <= {cut}" if cut else ""
    return f"""
both_hits as ({first} union all select query_id, log_id, score, pos + {k} from near),
united as (
  select query_id, log_id, arg_max(score, pos) as score, min(pos) as place from both_hits group by query_id, log_id),
cut as (select query_id, log_id, score, place as pos from united {cut_sql}),
firsts as (
  select query_id, log_id, score, pos from cut join o using (log_id)
  qualify row_number() over (partition by query_id, {_CONTENT} order by pos) = 1),
hits as (
  select query_id, row_number() over (partition by query_id order by pos) as pos, log_id, score from firsts)"""


_NEWEST = """
newest as (
  select 4::bigint as query_id, log_id, 1.0::double as score, row_number() over (order by ts desc, log_id) as pos
  from o qualify pos <= {k})"""

_BASE = f"o as ({_ORDERS}), {_asked(ORDER_QUERIES)}, " + _embedded(
    "e", "o", "log_id", "message"
) + "," + _embedded("qe", "asked", "query_id", "query")

ORACLES["hybrid_union"] = f"""
with {_BASE}, {_tokens_cte(_ORDER_QUERY_TOKENS)}, {_bm25_ctes(_ORDER_TEXTS, _ORDER_KEYS)},
{_lexical(100)}, {_NEWEST.format(k=100)}, {_near(100)},
{_merged(100, "select query_id, log_id, score, pos from words union all select * from newest")}
select query_id, pos, log_id, round(score, 6) as score,
  count(*) over (partition by query_id) as count from hits
"""

_TOP_FIVE = f"""
with {_BASE}, {_tokens_cte(_NO_RANGE)}, {_bm25_ctes(_ORDER_TEXTS, _ORDER_KEYS)},
{_lexical(5)}, {_near(5)}, {_merged(5, "select query_id, log_id, score, pos from words", cut=5)}
"""

ORACLES["hybrid_topn"] = f"{_TOP_FIVE} select query_id, pos, log_id, round(score, 6) as score from hits"

ORACLES["hits_as_text"] = f"""{_TOP_FIVE}
select query_id, string_agg(printf('%d. [%s] %s | Score: %.2f | Anomaly: %s' || chr(10) || '   %s',
  pos, {_INDEX_TS.format('ts')}, level, score, case when log_id % 2 = 1 then 'YES' else 'no' end, message),
  chr(10) order by pos) as text
from hits join o using (log_id) group by query_id
"""

ORACLES["answer_text"] = f"""
with {_BASE}, {_near(10)}
select query_id, 'Found ' || count(*) || ' logs matching your query:' || chr(10) || chr(10) ||
  string_agg(printf('%d. [%s] %s' || chr(10) || '   Source: %s, Timestamp: %s' || chr(10),
  pos, level, message, source, {_INDEX_TS.format('ts')}), '' order by pos) as text
from near join o using (log_id) group by query_id
"""

_PLAN_QUERIES = [
    (1, "order ORD000123", "ORD000123", None),
    (4, "Order ORD is URGENT", "zzzzzz", None),
    (5, "Order is LOW", "qqqqqq", ("1998-01-01", "1998-02-01")),
]
_plan_tokens = [(p[0], 0, p[2], *(p[3] or ())) for p in _PLAN_QUERIES]

ORACLES["lexical_else_vector"] = f"""
with o as ({_ORDERS}), {_asked([(p[0], p[1]) for p in _PLAN_QUERIES])}, {_embedded("e", "o", "log_id", "message")},
{_embedded("qe", "asked", "query_id", "query")}, {_tokens_cte(_plan_tokens)},
{_bm25_ctes(_ORDER_TEXTS, _ORDER_KEYS)}, {_lexical(20)},
dated as (
  select 3::bigint as query_id, log_id, 0.0::double as score, row_number() over (order by ts desc, log_id) as pos
  from o where ts between timestamp '1998-01-01' and timestamp '1998-01-03' qualify pos <= 20),
{_near(20, "query_id <> 5 or ts between timestamp '1998-01-01' and timestamp '1998-02-01'")},
found as (select * from words union all select * from dated),
all_hits as (
  select query_id, log_id, score, pos from found union all
  select query_id, log_id, score, pos from near where query_id not in (select query_id from found)),
firsts as (
  select query_id, log_id, score, pos from all_hits join o using (log_id)
  qualify row_number() over (partition by query_id, {_CONTENT} order by pos) = 1)
select query_id, row_number() over (partition by query_id order by pos) as pos, log_id, round(score, 6) as score
from firsts
"""

ORACLES["dedupe_content"] = "select min(doc_id) as doc_id, lang from documents group by lang, text"

_MESSAGES = """
select event_id as log_id, case when event_id % 2 = 0
  then 'user u' || user_id || ' did action ' || (event_id % 97)
  else 'plain note about number ' || event_id end as message,
  case when event_id % 2 = 0 then 'user <*> did action <*>' else 'plain note about number <*>' end as template
from events
"""

ORACLES["message_templates"] = f"""
select template, count(distinct message) as messages, count(*) as logs from ({_MESSAGES}) group by template
"""
ORACLES["attached_templates"] = f"select log_id, template as semantic_template from ({_MESSAGES})"
ORACLES["template_lookup"] = f"""
select log_id, case when message like 'user%' then 'stored' else template end as template from ({_MESSAGES})
"""

ORACLES["embedding_lookup"] = """
with users as (select distinct text from conversations where role = 'user'),
codes as (
  select conv_id, turn, text, range(0, 384) as cells,
    list_transform(regexp_extract_all(coalesce(text, ''), '(?s).'), lambda c: unicode(c)) as codes
  from conversations),
cells as (
  select conv_id, turn, text, list_transform(cells, lambda k: coalesce(list_sum(
    list_transform(range(k, len(codes), 384), lambda i: codes[i + 1] / 255.0)), 0.0::double)) as v
  from codes)
select conv_id * 1000 + turn as log_id,
  case when text in (select text from users) then 1.0::double
    else round((v[1] / greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-9))::float::double, 5)
  end as cell
from cells
"""

ORACLES["latest_reports"] = """
with reported as (
  select event_type || ' ' || user_id as message, 'report ' || event_id as llm_report, ts from events where value > 100),
latest as (
  select message, arg_max(llm_report, (ts, llm_report)) as llm_report from reported group by message)
select event_id as log_id, event_type || ' ' || user_id as message, llm_report
from events e left join latest l on l.message = e.event_type || ' ' || e.user_id
"""

ORACLES["tfidf_top100"] = r"""
with terms as (
  select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) as term from documents),
vocabulary as (
  select term, count(*) as n, count(distinct doc_id) as df from terms group by term order by n desc, term limit 100),
weighted as (
  select doc_id, term, count(*) * (ln((1.0 + (select count(*) from documents)) / (1 + any_value(df))) + 1) as w
  from terms join vocabulary using (term) group by doc_id, term)
select doc_id, term, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as weight from weighted
"""

ORACLES["sequence_anomaly"] = """
with histories as (
  select event_id, event_type, lag(event_type, 2) over w || ',' || lag(event_type, 1) over w as history,
    ('0x' || substr(md5(event_id::varchar), 1, 8))::bigint % 5 = 0 as test
  from events window w as (partition by user_id order by ts, event_id)),
expected as (
  select history, event_type from histories where not test and history is not null
  group by history, event_type
  qualify row_number() over (partition by history order by count(*) desc, event_type) <= 3)
select event_id, h.history, e.history is null as anomalous
from histories h left join expected e on e.history = h.history and e.event_type = h.event_type
where test and h.history is not null
"""

ORACLES["plan_parse"] = """
select conv_id, turn, turn % 5 in (1, 2) as no_search,
  case when turn % 5 in (0, 3) then text when turn % 5 = 4 then 'look for ' || role end as search_query,
  case when turn % 5 = 0 then role || '|ORD' || conv_id else '' end as tokens,
  case when turn % 5 = 0 then '2024-01-03 00:00:00' end as lo,
  case when turn % 5 = 0 then '2024-01-05 00:00:00' end as hi
from conversations
"""

_CONTEXT = f"""
select source, string_agg('{{"amount":"' || amount || '","anomaly_label":null,"anomaly_score":null' ||
  ',"customer_id":"' || customer_id || '","hold_reason":' ||
  coalesce('"' || hold_reason || '"', 'null') || ',"level":"' || level || '","message":"' || message ||
  '","order_lines":"' || order_lines || '","order_number":"' || order_number ||
  '","order_status":"' || order_status || '","shipping_provider":null,"source":"' || source ||
  '","timestamp":"' || {_INDEX_TS.format('ts')} || '","trace_id":"' || trace_id ||
  '","tracking_number":null}}', chr(10) order by pos) as context
from (select *, row_number() over (partition by source order by ts desc, log_id) as pos
  from ({_ORDERS}) qualify pos <= 20)
group by source
"""
_CONTEXT = _CONTEXT.replace('"anomaly_label":null,"anomaly_score":null\' ||\n  \',', "")

ORACLES["context_json"] = f"select source as query_id, context from ({_CONTEXT})"

_TALK = """
select conv_id,
  string_agg(upper(left(role, 1)) || lower(substr(role, 2)) || ': ' || text || chr(10), '' order by turn) as transcript
from {} group by 1
"""
ORACLES["transcripts"] = _TALK.format("conversations")

_with_current = """(
  select conv_id, turn, role, text from conversations
  union all select conv_id, max(turn) + 1, 'user', 'what broke?' from conversations group by conv_id
  having not (arg_max(role, turn) = 'user' and arg_max(text, turn) = 'what broke?'))"""

ORACLES["prompt_rows"] = f"""
with talks as ({_TALK.format(_with_current)}), contexts as ({_CONTEXT})
select conv_id as query_id, case when conv_id % 3 = 0
  then printf({_q(PLAIN_PROMPT)}, 'what broke?', transcript)
  else printf({_q(SEARCH_PROMPT)}, 'what broke?', 'broken orders', context, transcript) end as prompt
from talks join contexts on source =
  ['order-service', 'payment-service', 'inventory-service', 'shipping-service'][(conv_id % 4 + 1)::int]
"""

ORACLES["ingest_stream"] = f"""
select strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, order_number, level, source, message,
  strftime(ts, '%Y-%m-%d') as log_date, 384::bigint as vector_size, 0.0::double as anomaly_score,
  0::bigint as anomaly_label
from ({_ORDERS})
"""

ORACLES["parse_json_lookalikes"] = """
select event_id as log_id, '{"status": ' || user_id || '}' as message,
  '[{"amount":' || event_id || '}]' as order_lines from events
"""

ORACLES["parse_nested_names"] = """
select event_id as log_id,
  '[{"a":{"b":[{"c":{"amount":' || user_id || ',"d":{"amount":' || event_id || '}}}]}}]' as order_lines
from events
"""
