"""SQL equivalents of the catalogue's queries, for an independent engine."""

from __future__ import annotations

from .catalog import BOUNDS, EVENT_TYPES


def _q(expression: str) -> str:
    """Double to decimal(18,6), by way of three digits more."""
    return f"cast(cast({expression} as decimal(38,9)) as decimal(18,6))"


def _d(expression: str) -> str:
    return f"cast({expression} as decimal(18,6))"


def _with(*ctes: str) -> str:
    return "with recursive " + ",\n".join(ctes) + "\n"


# ---- inputs

SHARDS = """shards as (
  select 'suppliers' ref, cast(s_suppkey as varchar) uid, s_name id, r_name namespace, s_name name,
         'https://' || lower(n_name) || '.example.com:6443' server, s_acctbal
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""

VALUES = """measured as (
  select cast(l_suppkey as varchar) uid, count(*) n, sum(cast(l_quantity as decimal(18,2))) q,
         sum(cast(l_extendedprice as decimal(18,2))) x
  from lineitem group by l_suppkey),
vals as (
  select 'suppliers' ref, 'rows' metric_id, uid, cast(n as decimal(38,6)) v from measured
  union all select 'suppliers', 'quantity', uid, cast(q as decimal(38,6)) from measured
  union all select 'suppliers', 'price', uid, cast(x as decimal(38,6)) from measured)"""


def _stats(source: str) -> str:
    def pick(rank: str) -> str:
        return f"max(case when rn = {rank} then cast(v as double) end)"

    def middle(count: str, after: str) -> str:
        return f"({pick(f'{after} + ({count} + 1) // 2')} + {pick(f'{after} + ({count} + 2) // 2')}) / 2"

    return f"""ranked as (
  select *, row_number() over (partition by ref, metric_id order by v) rn,
         count(*) over (partition by ref, metric_id) n from {source}),
quart as (
  select ref, metric_id, n, {middle('n // 2', '0')} q1, {middle('n', '0')} median,
         {middle('n // 2', '(n - n // 2)')} q3
  from ranked group by ref, metric_id, n),
stats as (select *, case when n > 1 then q3 - q1 else 0.0 end iqr from quart)"""


SCALED = """scaled as (
  select v.ref, v.metric_id, uid,
         cast(cast(case when iqr = 0 then 0.0 else (cast(v as double) - median) / iqr end as decimal(38,9)) as decimal(38,6)) s
  from vals v join stats using (ref, metric_id)),
lift as (
  select ref, -cast(min(s) as double) + 0.01 * (cast(max(s) as double) - cast(min(s) as double)) o
  from scaled group by ref),
lifted as (
  select ref, metric_id, uid, cast(cast(cast(s as double) + o as decimal(38,9)) as decimal(38,6)) s
  from scaled join lift using (ref))"""


def _loads(p: int, name: str = "loads", source: str = "lifted") -> str:
    return f"""{name} as (
  select ref, uid,
         cast(cast(pow(sum(w * pow(cast(s as double), {p})), 1.0 / {p}) as decimal(38,9)) as decimal(38,6)) load
  from {source} join (values ('rows', 0.2::double), ('quantity', 0.3::double), ('price', 0.5::double)) t(metric_id, w)
    using (metric_id)
  group by ref, uid)"""


SUPPLIER = [VALUES, _stats("vals"), SCALED]

PARTS = """loads as (
  select 'parts' ref, cast(l_partkey as varchar) uid,
         cast(sum(cast(l_quantity as decimal(18,2))) as decimal(38,6)) load
  from lineitem group by l_partkey)"""


def _pack(source: str = "loads", cap: int | None = None, pinned: str = "false", out: str = "placed") -> str:
    """One recursive step per shard; a list holds the replicas' totals, another their sizes."""
    room = f"and sizes[k] < {cap}" if cap else ""
    return f"""{out}_ord as (
  select ref, uid, load, max(load) over (partition by ref) bucket,
         row_number() over (partition by ref order by ({pinned}) desc, load desc, uid) i
  from {source}),
{out} as (
  select ref, i, uid, load, 0 replica_id, [load] totals, [1] sizes from {out}_ord where i = 1
  union all
  select ref, i, uid, load, case when slot is null then len(totals) else slot - 1 end replica_id,
         case when slot is null then list_append(totals, load)
              else list_concat(totals[:slot - 1], [totals[slot] + load], totals[slot + 1:]) end totals,
         case when slot is null then list_append(sizes, 1)
              else list_concat(sizes[:slot - 1], [sizes[slot] + 1], sizes[slot + 1:]) end sizes
  from (
    select ref, i, uid, load, totals, sizes, case when list_min(fits) is not null then list_position(fits, list_min(fits)) end slot
    from (
      select o.ref, o.i, o.uid, o.load, p.totals, p.sizes,
             list_transform(p.totals, lambda t, k: case when t + o.load < o.bucket {room.replace('sizes', 'p.sizes')} then t end) fits
      from {out} p join {out}_ord o on o.ref = p.ref and o.i = p.i + 1)))"""


PLACED = f"select ref, uid, cast(replica_id as integer) replica_id, {_d('load')} \"value\" from placed"

EVENTS = """ev as (
  select event_id, cast(user_id as varchar) user_id, event_type, 'pod-' || (event_id % 3) pod,
         epoch_us(ts) us, value, props from events)"""

# seconds: whole days around all events, and an instant at 19 thirtieths of them
START = "(select epoch_us(min(ts)) // 86400000000 * 86400 from events)"
END = "(select (epoch_us(max(ts)) + 86399999999) // 86400000000 * 86400 from events)"
AS_OF = f"({START} + ({END} - {START}) // 86400 * 19 // 30 * 86400)"


def _grid(step: int) -> str:
    """Multiples of the step in (start, end], in micros."""
    return f"""grid as (
  select g * {step} * 1000000 g from (select unnest(range({START} // {step}, {END} // {step} + 1)) g)
  where g * {step} > {START})"""


def _instant(keys: str, lookback: int) -> str:
    return f"""vec as (
  select {keys}, g, arg_max(value, us) v
  from ev join grid on us <= g and us > g - {lookback}000000
  group by {keys}, g)"""


PEAKS = [
    EVENTS,
    _grid(6 * 3600),
    _instant("event_type, user_id, pod", 86_400),
    "pods as (select event_type, pod, g, sum(v) v from vec group by event_type, pod, g)",
    "peaks as (select event_type, g, max(v) v from pods group by event_type, g)",
]

PAIRS = [
    EVENTS,
    _grid(12 * 3600),
    """pairs as (
  select * from (
    select user_id, us, value v, lag(us) over w pus, lag(value) over w pv from ev
    window w as (partition by user_id order by us)) where pus is not null)""",
    """grown as (
  select user_id, g, us, pus, pv, case when v < pv then v else v - pv end d
  from pairs join grid on us <= g and pus > g - 86400000000)""",
]

EXTRAPOLATED = """edges as (
  select user_id, g, sum(d) d, count(*) gaps, min(pus) f, max(us) l, arg_min(pv, pus) fv
  from grown group by user_id, g),
spans as (
  select *, cast(l - f as double) s, cast(l - f as double) / gaps gap,
         cast(f - g + 86400000000 as double) ts0, cast(g - l as double) te0 from edges),
ends as (
  select *, case when ts0 >= gap * 1.1 then gap / 2 else ts0 end ts1,
         case when te0 >= gap * 1.1 then gap / 2 else te0 end te1,
         case when d > 0 and fv >= 0 then s * fv / d end z from spans)"""

WINDOWED = """six as (
  select cast((us // 21600000000 + 1) * 21600 as varchar) ref, event_type uid,
         cast(sum(cast(value as decimal(18,2))) as decimal(38,6)) load
  from ev group by 1, 2)"""

OBSERVED = """hashed as (
  select ref, sha256(string_agg(uid || '=' || replica_id, ',' order by uid)) h, max(replica_id) + 1 size
  from placed group by ref),
obs as (
  select cast(ref as bigint) tm, h, cast(size as integer) size, row_number() over (order by cast(ref as bigint)) i
  from hashed)"""

EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

ELECTION = f"""steps as (
  select cast(0 as bigint) i, cast(null as bigint) tm, cast(null as varchar) h, cast(null as varchar) winner,
         '{EMPTY}' proj, 0 psize, cast(null as bigint) pat, '{EMPTY}' elected, 0 esize, cast(null as bigint) eat,
         false promoted, false ready, cast(null as bigint) evaluated,
         cast([] as struct(h varchar, t bigint, n bigint)[]) hist
  union all
  select i, tm, h, winner, proj, psize, pat,
         case when promoted then proj else elected end, case when promoted then psize else esize end,
         case when promoted then pat else eat end, promoted, ready,
         case when promoted then tm else evaluated end,
         case when promoted then [{{'h': proj, 't': tm, 'n': cast(1 as bigint)}}] else hist end
  from (
    select *, ready and (evaluated is null or tm - evaluated >= case when psize < esize then 172800 else 86400 end) promoted
    from (
      select i, tm, h, winner, case when winner = h then h else proj end proj,
             case when winner = h then size else psize end psize, case when winner = h then tm else pat end pat,
             elected, esize, eat, evaluated, hist,
             winner is not distinct from case when winner = h then h else proj end ready
      from (
        select *, list_sort(list_transform(hist, lambda r: {{'a': -r.n, 'b': -r.t, 'h': r.h}}))[1].h winner
        from (
          select o.i, o.tm, o.h, o.size, s.proj, s.psize, s.pat, s.elected, s.esize, s.eat, s.evaluated,
                 list_filter(
                   case when list_contains(list_transform(s.hist, lambda r: r.h), o.h)
                        then list_transform(s.hist, lambda r: case when r.h = o.h
                               then {{'h': r.h, 't': o.tm, 'n': r.n + 1}} else r end)
                        else list_append(s.hist, {{'h': o.h, 't': o.tm, 'n': cast(1 as bigint)}}) end,
                   lambda r: r.t + 172800 > o.tm) hist
          from steps s join obs o on o.i = s.i + 1)))))"""

WINDOW_PLANS = [EVENTS, WINDOWED, _pack("six")]

# the same by user, with five days for six hours
USER_PLANS = [
    EVENTS,
    """five as (
  select user_id || '/' || cast((us // 432000000000 + 1) * 432000 as varchar) ref, event_type uid,
         cast(sum(cast(value as decimal(18,2))) as decimal(38,6)) load
  from ev group by 1, 2)""",
    _pack("five"),
    """hashed as (
  select ref, sha256(string_agg(uid || '=' || replica_id, ',' order by uid)) h, max(replica_id) + 1 size
  from placed group by ref),
obs as (
  select split_part(ref, '/', 1) ref, cast(split_part(ref, '/', 2) as bigint) tm, h, cast(size as integer) size,
         row_number() over (partition by split_part(ref, '/', 1) order by cast(split_part(ref, '/', 2) as bigint)) i
  from hashed)""",
]
USER_STEPS = (
    ELECTION.replace("select cast(0 as bigint) i,", "select ref, cast(0 as bigint) i,")
    .replace("[]) hist\n", "[]) hist from (select distinct ref from obs)\n")
    .replace("select i, tm, h, winner,", "select ref, i, tm, h, winner,")
    .replace("select o.i, o.tm,", "select o.ref, o.i, o.tm,")
    .replace("join obs o on o.i = s.i + 1", "join obs o on o.ref = s.ref and o.i = s.i + 1")
)
USER_ELECTION = USER_STEPS.replace("172800", "864000").replace("86400 end promoted", "432000 end promoted")
# six hours again, with their periods
USER_SIX_PLANS = [c.replace("432000", "21600").replace("five", "six") for c in USER_PLANS]


def _relation(name: str, kind: str, labels: str, value: str, source: str) -> str:
    return f"select '{name}' relation, '{kind}' \"type\", ref, {labels}, {_q(value)} \"value\" from {source}"


SHARD_LABELS = "uid shard_uid, id shard_id, namespace shard_namespace, name shard_name, server shard_server"
ATTRS = "join (select uid, id, namespace, name, server from shards) using (uid)"
MWTP = "most_wanted_two_phase_hysteresis"
LPT = "longest_processing_time"


def _elected(name: str, column: str, total: bool) -> str:
    last = f"(select ref, {column} tm from steps qualify row_number() over (partition by ref order by i desc) = 1) e"
    source = f"placed p join {last} on p.ref = e.ref || '/' || cast(e.tm as varchar)"
    if total:
        inner = f"(select e.ref, replica_id, sum(load) t from {source} group by e.ref, replica_id)"
        return _relation(name, MWTP, "cast(replica_id as integer) replica_id", "t", inner)
    inner = f"(select e.ref, uid, replica_id from {source})"
    return _relation(name, MWTP, "uid shard_uid, cast(replica_id as integer) replica_id", "1", inner)


def _polled(keys: str, days: int, ref: str) -> list[str]:
    values = ", ".join(f"('{t}')" for t in EVENT_TYPES)
    return [
        EVENTS,
        f"""found as (
  select event_type metric_id, user_id uid, count(*) samples, max(v) v from (
    select {keys}, arg_max(value, us) v from ev
    where us <= {AS_OF} * 1000000 and us > {AS_OF} * 1000000 - {days} * 86400000000 group by {keys})
  group by event_type, user_id)""",
        f"""polled as (
  select {ref} ref, metric_id, uid, 'last(' || metric_id || '{{user="' || uid || '"}})' query,
         case when samples is null then {_d('0')} when samples = 1 then {_q('v')} end "value",
         coalesce(samples, 0) samples
  from (select distinct user_id uid from ev) cross join (values {values}) m(metric_id)
  left join found using (metric_id, uid))""",
    ]


POD_POLL = _polled("event_type, user_id, pod", 4, "'user-' || uid")
POLL_FAILED = """failed as (
  select ref, 'more than one sample: ' || samples || ', query:' || chr(10) || query message
  from polled where samples > 1)"""

CHANGES = """changes as (
  select * from (
    select user_id target, us at_us, cast(floor(value / 40) as integer) to_replicas,
           lag(cast(floor(value / 40) as integer)) over (partition by user_id order by us) from_replicas
    from ev) where from_replicas <> to_replicas)"""

ELECTED = """select ref, tm "at", h plan_hash, winner, proj projection, psize projection_size, elected,
  esize elected_size, promoted, case when ready then 'Ready' else 'AwaitingNewProjection' end reason,
  evaluated last_evaluation, cast(list_sum(list_transform(hist, lambda r: r.n)) as bigint) votes
from steps where i > 0"""

ORACLES: dict[str, str] = {
    "flagship": _with(SHARDS, *SUPPLIER, _loads(1), _pack())
    + f"""select ref, cast(replica_id as integer) replica_id, uid, id, namespace, name, server, {_d('load')} "value"
from placed {ATTRS}""",
    "nested_replicas": _with(PARTS, _pack())
    + f"""select ref, cast(replica_id as integer) replica_id, 0 part, cast(count(*) as integer) shards,
       string_agg(uid, ',' order by load desc, uid) shard_uids, {_d('sum(load)')} total_load,
       cast(cast(sum(load) as bigint) as varchar) total_load_display
from placed group by ref, replica_id""",
    "nested_replicas_in_parts": _with(PARTS, _pack())
    + f"""select ref, cast(replica_id as integer) replica_id,
       cast(row_number() over (r order by load desc, uid) - 1 as integer) part, 1 shards, uid shard_uids,
       {_d('sum(load) over r')} total_load, cast(cast(sum(load) over r as bigint) as varchar) total_load_display
from placed window r as (partition by ref, replica_id)""",
    "discover_shards": _with(SHARDS) + "select ref, uid, id, namespace, name, server from shards where s_acctbal >= 0",
    "scan_samples": _with(EVENTS)
    + f"""select user_id, us at_us, {_q('value')} "value" from ev
where event_type = 'purchase' and pod <> 'pod-1' and json_extract_string(props, '$.k') not in ('0', '1', '2')""",
    "bind_labels": """select page_id, host, case when host = 'www.example.com' then '100.64.0.1:443' else host end bound
from (select page_id, regexp_extract(url, '^[a-z]+://(?:[^@/?#]*@)?([^/?#]*)', 1) host from pages)""",
    "ingest_quantities": """select l_orderkey, l_linenumber, n || s "text",
  cast(cast(n as decimal(18,9)) * f as decimal(38,9)) quantity, regexp_replace(cast(l_extendedprice * 1000 as varchar), '\\.0$', '') display
from (select *, cast(cast(l_quantity as integer) as varchar) n from lineitem)
join (values (1, 'n', 0.000000001), (2, 'u', 0.000001), (3, 'm', 0.001), (4, '', 1), (5, 'k', 1000), (6, 'Ki', 1024), (7, 'e2', 100))
  t(l_linenumber, s, f) using (l_linenumber)""",
    "instant_vector": _with(EVENTS, _grid(6 * 3600), _instant("user_id, event_type", 43_200))
    + f'select user_id, event_type, g // 1000000 "at", {_q("v")} "value" from vec',
    "sum_by_pod_max": _with(*PEAKS) + f'select event_type, g // 1000000 "at", {_q("v")} "value" from peaks',
    "quantile_over_time": _with(*PEAKS)
    + f'select event_type, {_q("quantile_cont(v, 0.95)")} "value" from peaks group by event_type',
    "quantile_over_time_by_user": _with(
        EVENTS,
        _grid(6 * 3600),
        _instant("user_id, event_type, pod", 86_400),
        "peaks as (select user_id, event_type, g, max(v) v from vec group by user_id, event_type, g)",
    )
    + f'select user_id, event_type, {_q("quantile_cont(v, 0.95)")} "value" from peaks group by user_id, event_type',
    "max_over_time": _with(*PEAKS) + f'select event_type, {_q("max(v)")} "value" from peaks group by event_type',
    "increase": _with(*PAIRS)
    + f'select user_id, g // 1000000 "at", {_q("sum(d)")} "value" from grown group by user_id, g',
    "increase_extrapolated": _with(*PAIRS, EXTRAPOLATED)
    + f"""select user_id, g // 1000000 "at", {_q('d * (s + least(ts1, coalesce(z, ts1)) + te1) / s')} "value" from ends""",
    "increase_stream": _with(*PAIRS)
    + f"""select user_id, g // 1000000 "at", {_q("sum(d)")} "value" from grown
where g // 1000 <= (select epoch_us(max(ts)) // 1000 - 3600000 from events) group by user_id, g""",
    "rate_percent": _with(*PAIRS)
    + f'select user_id, g // 1000000 "at", {_q("sum(d) / 86400 * 100")} "value" from grown group by user_id, g',
    "histogram_quantile": _with(
        EVENTS,
        "les as (select unnest([%s, 'inf'::double]) le)" % ", ".join(str(b) for b in BOUNDS),
        """cum as (
  select event_type, user_id, le, sum(case when value <= le then 1.0::double else 0.0::double end) c
  from ev cross join les group by event_type, user_id, le)""",
        """steps as (
  select *, max(c) over (partition by event_type, user_id) total,
         coalesce(lag(le) over w, 0.0) low, coalesce(lag(c) over w, 0.0) below
  from cum window w as (partition by event_type, user_id order by le))""",
        """hit as (
  select event_type, user_id, arg_min({'le': le, 'low': low, 'below': below, 'c': c, 'r': 0.9 * total}, le) s
  from steps where c >= 0.9 * total group by event_type, user_id)""",
    )
    + f"""select event_type, user_id, {_q('''case when isinf(s.le) then s.low
  else s.low + (s.le - s.low) * case when s.c > s.below then (s.r - s.below) / (s.c - s.below) else 0 end end''')} "value" from hit""",
    "poll_cross_fill": _with(*_polled("event_type, user_id", 2, "'users'"))
    + 'select metric_id, uid, query, "value", samples from polled',
    "require_single_sample": _with(*POD_POLL, POLL_FAILED)
    + "select 'poll' stage, ref, 'PollingError' reason, message from failed",
    "stale_refs": _with(
        EVENTS,
        f"""p as (select user_id ref, max(case when us < {AS_OF} * 1000000 then us end) last,
  list_sort(list(distinct event_type) filter (where us < {AS_OF} * 1000000)) b,
  list_sort(list(distinct event_type) filter (where us >= {AS_OF} * 1000000)) a from ev group by user_id)""",
        f"""r as (select ref, ({AS_OF} * 1000000 - last) / 1e6 age,
  case when last is null then 'NeverPolled' when ({AS_OF} * 1000000 - last) / 1e6 >= 43200 then 'PeriodElapsed'
       when a is distinct from b then 'ShardsChanged' else 'Fresh' end reason from p)""",
    )
    + f"""select ref, reason <> 'Fresh' stale, reason,
  {_q("case when reason = 'Fresh' then 43200 - age else 0 end")} remaining_s from r""",
    "quartiles": _with(VALUES, _stats("vals"))
    + f"""select ref, metric_id, n, {_q('q1')} q1, {_q('median')} median, {_q('q3')} q3, {_q('iqr')} iqr from stats""",
    "quartiles_bracketed": _with(
        "vals as (select l_linestatus ref, l_returnflag metric_id, l_extendedprice v from lineitem)", _stats("vals")
    )
    + f"""select ref, metric_id, n, {_q('q1')} q1, {_q('median')} median, {_q('q3')} q3, {_q('iqr')} iqr from stats""",
    "robust_scale": _with(*SUPPLIER) + f'select ref, metric_id, uid, {_d("s")} "value" from scaled',
    "robust_scale_offset": _with(*SUPPLIER) + f'select ref, metric_id, uid, {_d("s")} "value" from lifted',
    "metric_exactly_once": _with(
        EVENTS,
        """n as (select strftime(make_timestamp(us), '%Y-%m-%d') ref, user_id uid, event_type metric_id, count(*) n
  from ev group by all)""",
    )
    + """select 'load_index' stage, ref, 'LoadIndexCalculationError' reason,
  'metric ' || metric_id || ' must occur once in shard ' || uid message
from (select distinct ref, uid from n) cross join (values ('click'), ('view')) w(metric_id)
left join n using (ref, uid, metric_id) where coalesce(n, 0) <> 1""",
    "lpt_assignments": _with(*SUPPLIER, _loads(1), _pack()) + PLACED,
    "lpt_replicas": _with(*SUPPLIER, _loads(1), _pack())
    + f"""select ref, cast(replica_id as integer) replica_id, count(*) shards, {_d('sum(load)')} total_load
from placed group by ref, replica_id""",
    "lpt_pinned": _with(*SUPPLIER, _loads(1), _pack(pinned="uid = '7'")) + PLACED,
    "lpt_parts": _with(PARTS, _pack()) + PLACED,
    "lpt_parts_sliced": _with(PARTS, _pack()) + PLACED,
    "lpt_equal_loads": _with(
        """loads as (
  select 'sizes' ref, cast(p_partkey as varchar) uid, cast(case when p_partkey % 3 = 0 then 0 else p_size end as decimal(38,6)) load from part)""",
        _pack(),
    )
    + PLACED,
    "lpt_capped": _with(PARTS, _pack(cap=1)) + PLACED,
    "lpt_by_nation": _with(
        """loads as (
  select n_name ref, cast(c_custkey as varchar) uid,
         cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(38,6)) load
  from customer join orders on c_custkey = o_custkey join nation on c_nationkey = n_nationkey
  group by n_name, c_custkey)""",
        _pack(cap=2),
    )
    + PLACED,
    "bucket_sizes": _with(*SUPPLIER, _loads(1), _pack())
    + f"""select ref, {_d('max(load)')} bucket, cast(max(replica_id) + 1 as integer) replicas from placed group by ref""",
    "plan_quality": _with(
        PARTS,
        _pack(),
        "t as (select ref, replica_id, sum(load) total, max(load) largest from placed group by ref, replica_id)",
        """a as (select ref, count(*) n, max(total) m, cast(sum(total) as double) / count(*) mean,
  cast(max(largest) as double) b from t group by ref)""",
    )
    + f"""select ref, cast(n as integer) replicas, {_d('m')} makespan, {_q('cast(m as double) / mean')} spread,
  {_q('mean / b')} fill from a""",
    "plan_key_hash": _with(*SUPPLIER, _loads(1), _pack())
    + """select ref, 0 piece, plan_key, sha256(plan_key) plan_hash, replicas, shards from (
  select ref, string_agg(uid || '=' || replica_id, ',' order by uid) plan_key,
         cast(max(replica_id) + 1 as integer) replicas, count(*) shards from placed group by ref)""",
    "plan_hash_streamed": _with(PARTS, _pack())
    + """select ref, sha256(string_agg(uid || '=' || replica_id, ',' order by uid)) plan_hash,
  cast(max(replica_id) + 1 as integer) replicas, count(*) shards from placed group by ref""",
    "plan_equal": _with(
        *WINDOW_PLANS,
        "later as (select cast(cast(ref as bigint) + 21600 as varchar) ref, uid, replica_id from placed)",
        "both_ as (select ref, uid, a.replica_id x, b.replica_id y from placed a full join later b using (ref, uid))",
    )
    + "select ref, bool_and(x is not distinct from y) equal from both_ group by ref",
    "evaluation_replay": _with(*USER_SIX_PLANS, USER_STEPS) + ELECTED,
    "vote_counts": _with(*WINDOW_PLANS, OBSERVED)
    + """select 'fleet' ref, h plan_hash, tm + d * 21600 "at", count(*) votes
from obs cross join range(0, 8) r(d) group by h, tm + d * 21600""",
    "relation_discovered_shards": _with(SHARDS, *SUPPLIER, _loads(1), _pack())
    + _relation(
        "shard_manager_discovered_shards",
        "secret_type_cluster",
        f"{SHARD_LABELS}, replica_id",
        "1",
        "shards left join (select uid, cast(replica_id as integer) replica_id from placed) using (uid)",
    ),
    "relation_poll_values": _with(SHARDS, VALUES)
    + _relation("poll_values", "prometheus", f"{SHARD_LABELS}, metric_id", "v", f"vals {ATTRS}"),
    "relation_normalizer_values": _with(SHARDS, *SUPPLIER)
    + _relation("normalizer_values", "robust_scaling", f"{SHARD_LABELS}, metric_id", "s", f"lifted {ATTRS}"),
    "relation_load_index_values": _with(SHARDS, *SUPPLIER, _loads(1))
    + _relation("load_index_values", "weighted_p_norm", SHARD_LABELS, "load", f"loads {ATTRS}"),
    "relation_partition_shards": _with(SHARDS, *SUPPLIER, _loads(1), _pack())
    + _relation(
        "partition_shards", LPT, f"{SHARD_LABELS}, cast(replica_id as integer) replica_id", "1", f"placed {ATTRS}"
    ),
    "relation_partition_total_load": _with(*SUPPLIER, _loads(1), _pack())
    + _relation(
        "partition_replicas_total_load",
        LPT,
        "cast(replica_id as integer) replica_id",
        "t",
        "(select ref, replica_id, sum(load) t from placed group by ref, replica_id)",
    ),
    "relation_projected_shards": _with(*USER_PLANS, USER_ELECTION)
    + _elected("evaluation_projected_shards", "pat", False),
    "relation_projected_total_load": _with(*USER_PLANS, USER_ELECTION)
    + _elected("evaluation_projected_replicas_total_load", "pat", True),
    "relation_evaluation_shards": _with(*USER_PLANS, USER_ELECTION)
    + _elected("evaluation_shards", "eat", False),
    "relation_evaluation_total_load": _with(*USER_PLANS, USER_ELECTION)
    + _elected("evaluation_replicas_total_load", "eat", True),
    "relation_replica_set_changes": _with(EVENTS, CHANGES)
    + f"""select 'replica_set' "type", 'fleet' ref, 'StatefulSet' target_kind, target, {_q('count(*)')} "value"
from changes group by target""",
    "gauge_rollup": _with(SHARDS, *SUPPLIER, _loads(1), _pack())
    + f"""select 'prometheus' "type", ref, name || '/' || metric_id "label", {_q('sum(v)')} "value"
from vals {ATTRS} group by ref, name, metric_id
union all
select '{LPT}', ref, cast(replica_id as varchar), {_q('sum(load)')} from placed group by ref, replica_id""",
    "stage_status": _with(*POD_POLL, POLL_FAILED)
    + """select 'poll' stage, ref, message is null ready, case when message is null then 'Ready' else 'PollingError' end reason,
  coalesce(message, '') message
from (select distinct ref from polled) left join (select ref, min(message) message from failed group by ref) using (ref)""",
    "ready_values": _with(*POD_POLL, POLL_FAILED)
    + """select ref, metric_id what, "value" from polled where ref not in (select ref from failed)
union all select distinct ref, 'MetricValuesProviderNotReady', cast(null as decimal(18,6)) from failed""",
    "duplicate_ids": """select 'load_index' stage, p_brand ref, 'WeightsMalformed' reason, 'duplicate id ' || p_size message
from part group by p_brand, p_size having count(*) > 1""",
    "change_log": _with(EVENTS, CHANGES) + "select target, at_us, from_replicas, to_replicas from changes",
}

ORACLES["evaluation_stream"] = _with(*USER_PLANS, USER_ELECTION) + ELECTED
ORACLES["quartiles_refined"] = ORACLES["quartiles_bracketed"]

ORACLES["set_equality"] = (
    _with(EVENTS)
    + f"""select user_id ref,
  coalesce(list_sort(list(distinct event_type) filter (where us < {AS_OF} * 1000000)), [])
    = coalesce(list_sort(list(distinct event_type) filter (where us >= {AS_OF} * 1000000)), []) same
from ev group by user_id"""
)

ORACLES["not_finite"] = (
    _with(
        *SUPPLIER,
        """sums as (
  select ref, uid, sum(w * pow(cast(s as double), 3)) total
  from scaled join (values ('rows', 0.2::double), ('quantity', 0.3::double), ('price', 0.5::double)) t(metric_id, w)
    using (metric_id) group by ref, uid)""",
    )
    + """select 'load_index' stage, ref, 'LoadIndexCalculationError' reason, 'not a finite value: NaN' message,
  count(*) shards from sums where total < 0 group by ref"""
)

for _p in (1, 2, 3):
    ORACLES[f"load_index_p{_p}"] = (
        _with(SHARDS, *SUPPLIER, _loads(_p)) + f'select ref, uid, name, {_d("load")} "value" from loads {ATTRS}'
    )

TWO_PLANS = [
    *SUPPLIER,
    _loads(1, "loads1"),
    _loads(2, "loads2"),
    _pack("loads1", out="placed1"),
    _pack("loads2", out="placed2"),
    """diff as (
  select ref, uid, a.replica_id x, b.replica_id y,
         case when a.replica_id is null then 'added' when b.replica_id is null then 'removed'
              when a.replica_id <> b.replica_id then 'moved' else 'kept' end change
  from placed1 a full join placed2 b using (ref, uid))""",
]
ORACLES["plan_diff"] = (
    _with(*TWO_PLANS)
    + """select ref, uid, change, cast(x as integer) from_replica, cast(y as integer) to_replica
from diff where change <> 'kept'"""
)
ORACLES["plan_delta"] = (
    _with(*TWO_PLANS)
    + """select ref, count(*) filter (where change = 'added') added, count(*) filter (where change = 'removed') removed,
  count(*) filter (where change = 'moved') moved, count(*) filter (where change = 'kept') kept,
  cast(coalesce(max(y) + 1, 0) - coalesce(max(x) + 1, 0) as integer) replica_delta from diff group by ref"""
)

ROLLOUT = """with s as (
  select cast(o_orderkey as varchar) ref, cast(o_custkey as varchar) target,
         epoch_us(cast(o_orderdate as date)) + o_orderkey us, o_orderpriority <> '1-URGENT' dm, o_orderpriority in ('1-URGENT', '5-LOW') xm,
         o_orderstatus = 'F' rr, day(o_orderdate) d, cast(floor(o_totalprice) as bigint) p from orders),
t as (
  select *, p % 2 = 1 spec_differs, p % 7 = 0 managed_differs, p % 5 = 0 scaler_differs,
         (p % 7 = 0) <> (p % 5 = 0) pair_differs, p % 3 want,
         case when p % 11 <> 0 then (p // 3) % 3 end spec, (p // 9) % 3 actual from s),
u as (select *, xm and scaler_differs pending, coalesce(spec = 0, false) or actual = 0 is_zero from t),
v as (
  select *, case
    when dm and xm then 'ErrorResourceMalformedDuplicateModes'
    when d = 31 then 'Paused'
    when d = 30 then 'PartitionProviderNotReady'
    when d = 29 then 'ShardManagerNotReady'
    when pending and actual > 0 and coalesce(spec > 0, true) then 'BeginningScalingToZero'
    when pending and actual > 0 then 'WaitingForRSControllerToScaleToZero'
    when not pending and want > 0 and is_zero then 'EnforcingDesiredState'
    when managed_differs then 'WaitingForShardManagerToApplyDesiredState'
    when pair_differs then 'BeginningRSControllerScaling'
    when spec is null or spec <> want or (want > 0 and actual = 0) then 'EnforcingDesiredState'
    when actual <> want then 'WaitingForRSControllerToScale'
    else 'Ready' end state from u),
w as (
  select *,
  state not in ('ErrorResourceMalformedDuplicateModes', 'Paused', 'PartitionProviderNotReady', 'ShardManagerNotReady',
    'BeginningScalingToZero', 'WaitingForRSControllerToScaleToZero')
    and not (not pending and want > 0 and is_zero) and spec_differs hand_over,
  (state = 'BeginningRSControllerScaling' and ((dm and rr and not xm) or actual <> want))
    or state in ('BeginningScalingToZero', 'EnforcingDesiredState') scale_now
from v)"""
ORACLES["rollout_state"] = ROLLOUT + " select ref, state, hand_over, scale_now from w"
TRANSITIONS = ROLLOUT + """,
steps as (
  select *, lag(state) over o pstate, lag(want) over o pwant, lag(us) over o pus from w
  window o as (partition by target order by us)),
entered as (
  select target, us at_us, case state when 'BeginningScalingToZero' then 'to_zero' when 'EnforcingDesiredState' then 'enforce'
         else case when actual <> want then 'scale' else 'restart' end end kind, cast(actual as integer) from_replicas,
         cast(case when state = 'BeginningScalingToZero' then 0 else want end as integer) to_replicas
  from steps where scale_now and (pus is null or state <> pstate or want <> pwant))"""
ORACLES["transition_log"] = TRANSITIONS + " select *, kind <> 'to_zero' counted from entered"
ORACLES["relation_scaler_changes"] = (
    TRANSITIONS
    + f""" select 'replica_set' "type", 'fleet' ref, 'StatefulSet' target_kind, target, {_q('count(*)')} "value"
from entered where kind <> 'to_zero' group by target"""
)
ORACLES["desired_replicas"] = (
    _with(
        """loads as (
  select n_name ref, cast(c_custkey as varchar) uid, cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(38,6)) load
  from customer join orders on c_custkey = o_custkey join nation on c_nationkey = n_nationkey
  where n_nationkey % 2 = 0 group by n_name, c_custkey)""",
        _pack(cap=2),
    )
    + """select n_name ref, cast(coalesce(max(replica_id) + 1, 0) as integer) desired_replicas
from nation left join placed on ref = n_name group by n_name"""
)
ORACLES["normalized_display"] = (
    _with(*SUPPLIER)
    + f"""select ref, metric_id, uid, {_q('case when iqr = 0 then 0.0 else (cast(v as double) - median) / iqr end')} display,
  {_d('lifted.s')} "value" from lifted join vals using (ref, metric_id, uid) join stats using (ref, metric_id)"""
)


ORACLES["relation_store"] = (
    _with(EVENTS, f"half as (select *, us >= ({START} * 1000000 + ({END} - {START}) * 500000) late from ev)")
    + f"""select user_id ref, event_type "label", {_d("sum(cast(value as decimal(18,2)))")} "value" from half
where not late and user_id not in (select user_id from half where late) group by user_id, event_type
union all
select user_id, event_type, {_d("sum(cast(value as decimal(18,2)))")} from half
where late and user_id in (select user_id from half where late and event_type = 'purchase') group by user_id, event_type"""
)


def _rolled(name: str, kind: str, ref: str, label: str, value: str, source: str) -> str:
    return f"""select '{name}' relation, '{kind}' "type", {ref} ref, {label} "label", {_q(f'sum({value})')} "value" from {source} group by {ref}, {label}"""


def _rolled_election(prefix: str, column: str) -> list[str]:
    last = f"(select ref, {column} tm from steps qualify row_number() over (partition by ref order by i desc) = 1) e"
    source = f"five_placed p join {last} on p.ref = e.ref || '/' || cast(e.tm as varchar)"
    label = "cast(replica_id as varchar)"
    return [
        _rolled(f"{prefix}_shards", MWTP, "e.ref", label, "1", source),
        _rolled(f"{prefix}_replicas_total_load", MWTP, "e.ref", label, "load", source),
    ]


ORACLES["all_rollups"] = _with(
    SHARDS, *SUPPLIER, _loads(1), _pack(),
    *[c.replace("placed", "five_placed") for c in USER_PLANS[:3]], *[c.replace("from placed", "from five_placed") for c in USER_PLANS[3:]], USER_ELECTION,
) + "\nunion all\n".join(
    [
        _rolled("shard_manager_discovered_shards", "secret_type_cluster", "ref", "''", "1", "shards"),
        _rolled("normalizer_values", "robust_scaling", "ref", "name || '/' || metric_id", "s", f"lifted {ATTRS}"),
        _rolled("load_index_values", "weighted_p_norm", "ref", "name", "load", f"loads {ATTRS}"),
        _rolled("partition_shards", LPT, "ref", "cast(replica_id as varchar)", "1", "placed"),
        *_rolled_election("evaluation_projected", "pat"),
        *_rolled_election("evaluation", "eat"),
    ]
)

RUN_GRID = f"""grid as (
  select g * 21600 * 1000000 g from (select unnest(range(({AS_OF} - 864000) // 21600, {AS_OF} // 21600 + 1)) g)
  where g * 21600 > {AS_OF} - 864000)"""

ORACLES["strategy_run"] = (
    _with(
        EVENTS.replace("ev as", "raw as"),
        "ev as (select *, json_extract_string(props, '$.k') k from raw)",
        RUN_GRID,
        """gauge as (
  select event_type, user_id, pod, k, g, arg_max(value, us) v
  from ev join grid on us <= g and us > g - 172800000000
  where event_type in ('view', 'error') group by all)""",
        """pairs as (
  select * from (
    select user_id, pod, k, us, value v, lag(us) over w pus, lag(value) over w pv
    from ev where event_type = 'purchase'
    window w as (partition by user_id, pod, k order by us)) where pus is not null)""",
        """counter as (
  select 'purchase' event_type, user_id, pod, k, g, sum(case when v < pv then v else v - pv end) v
  from pairs join grid on us <= g and pus > g - 432000000000 group by all)""",
        """pods as (
  select event_type, user_id, pod, g, sum(v) v from (select * from gauge union all select * from counter) group by all)""",
        "peaks as (select event_type, user_id, g, max(v) v from pods group by all)",
        """found as (
  select case event_type when 'view' then 'views' when 'error' then 'errors' else 'spent' end metric_id,
         user_id uid, quantile_cont(v, 0.95) v from peaks group by all)""",
        """vals as (
  select 'users' ref, metric_id, uid, cast(cast(coalesce(v, 0) as decimal(38,12)) as decimal(38,9)) v
  from (select distinct user_id uid from ev) cross join (values ('views'), ('errors'), ('spent')) m(metric_id)
  left join found using (metric_id, uid))""",
        _stats("vals"),
        SCALED.replace("decimal(38,9)", "decimal(38,12)").replace("decimal(38,6)", "decimal(38,9)"),
        """loads as (
  select ref, uid, cast(cast(sum(w * cast(s as double)) as decimal(38,12)) as decimal(38,9)) load
  from lifted join (values ('views', 0.5::double), ('errors', 0.25::double), ('spent', 0.25::double)) t(metric_id, w)
    using (metric_id) group by ref, uid)""",
        _pack(),
    )
    + PLACED
)


def _readings(ref: str, step: int, window: int, lookback: int, reach: int, q: float, where: str) -> list[str]:
    """CTEs of one strategy's polled values: ``<ref>_found`` (metric_id, uid, v)."""
    grid = f"(select unnest(range(({AS_OF} - {window}) // {step}, {AS_OF} // {step} + 1)) * {step} n)"
    return [
        f"{ref}_grid as (select n * 1000000 g from {grid} where n > {AS_OF} - {window})",
        f"""{ref}_gauge as (
  select event_type, user_id, pod, k, g, arg_max(value, us) v
  from ev join {ref}_grid on us <= g and us > g - {lookback}000000
  where event_type in ('view', 'error') and {where} group by all)""",
        f"""{ref}_counter as (
  select event_type, user_id, pod, k, g, sum(case when v < pv then v else v - pv end) v
  from (select event_type, user_id, pod, k, us, value v, lag(us) over w pus, lag(value) over w pv from ev
        where event_type = 'purchase' and {where} window w as (partition by user_id, pod, k order by us))
  join {ref}_grid on us <= g and pus > g - {reach}000000 group by all)""",
        f"""{ref}_pods as (
  select event_type, user_id, pod, g, sum(v) v from (select * from {ref}_gauge union all select * from {ref}_counter) group by all)""",
        f"{ref}_peaks as (select event_type, user_id, g, max(v) v from {ref}_pods group by all)",
        f"""{ref}_found as (
  select '{ref}' ref, case event_type when 'view' then 'views' when 'error' then 'errors' else 'spent' end metric_id,
         user_id uid, quantile_cont(v, {q}) v from {ref}_peaks group by all)""",
    ]


_PODS = "pod <> 'pod-1' and try_cast(k as integer) between 0 and 49"
FLEET_VALUES = [
    EVENTS.replace("ev as", "raw as"),
    "ev as (select *, json_extract_string(props, '$.k') k from raw)",
    *_readings("plain", 21600, 864000, 172800, 432000, 0.95, "true"),
    *_readings("pods", 43200, 518400, 86400, 259200, 0.5, _PODS),
    """vals as (
  select ref, metric_id, uid, cast(cast(coalesce(v, 0) as decimal(38,12)) as decimal(38,9)) v
  from (select distinct user_id uid from ev) cross join (values ('views'), ('errors'), ('spent')) m(metric_id)
  cross join (values ('plain'), ('pods')) r(ref)
  left join (from plain_found union all from pods_found) using (ref, metric_id, uid)
  union all
  select 'fresh', metric_id, uid, v from (select user_id uid, cast(count(*) as decimal(38,9)) v from ev group by user_id)
  cross join (values ('views'), ('errors'), ('spent')) m(metric_id))""",
]
ORACLES["fleet_values"] = _with(*FLEET_VALUES) + f'select ref, metric_id, uid, {_d("v")} "value" from vals'
ORACLES["fleet_status"] = """select stage, ref, ready, reason, message from (values
  ('poll', 'MetricValuesProviderNotReady'), ('normalize', 'MetricValuesProviderNotReady'), ('load_index', 'MetricValuesProviderNotReady'),
  ('partition', 'LoadIndexProviderNotReady')) s(stage, waits)
cross join lateral (
  select ref, ref <> 'twice' ready,
    case when ref <> 'twice' then 'Ready' when stage = 'poll' then 'MalformedResource' else waits end reason,
    case when ref = 'twice' and stage = 'poll' then 'duplicate id views' else '' end message
  from (values ('plain'), ('pods'), ('twice'), ('fresh')) r(ref))
union all
select 'gate', ref, ref <> 'fresh', case when ref = 'fresh' then 'Fresh' else 'NeverPolled' end, '' from (values ('plain'), ('pods'), ('twice'), ('fresh')) r(ref)"""
ORACLES["fleet_assignments"] = (
    _with(
        *FLEET_VALUES,
        _stats("vals"),
        SCALED.replace("decimal(38,9)", "decimal(38,12)").replace("decimal(38,6)", "decimal(38,9)").replace("0.01 *", "case when ref = 'pods' then 0.05 else 0.01 end *"),
        """loads as (
  select ref, uid, cast(cast(pow(sum(w * pow(cast(s as double), case when ref = 'pods' then 2 else 1 end)), 1.0 / max(case when ref = 'pods' then 2 else 1 end))
         as decimal(38,12)) as decimal(38,9)) load
  from lifted join (values ('views', 0.5::double), ('errors', 0.25::double), ('spent', 0.25::double)) t(metric_id, w)
    using (metric_id) group by ref, uid)""",
        _pack(),
    )
    + PLACED
)
