"""Fragments of SQL used to state the expected rows of the registered queries."""

from __future__ import annotations

from standpoint.plans.registry import cte
from standpoint.sources import derive as D


def th(*parts: str) -> str:
    """sha256 over length-prefixed parts."""
    pieces = [f"unhex(printf('%016x', octet_length(encode({p})))) || encode({p})" for p in parts]
    return f"sha256({' || '.join(pieces)})"


def sec(x: str) -> str:
    return f"coalesce(cast(cast(round({x} * 1e6) as bigint) as varchar), '')"


PAYLOAD_KEY = ("case when text is null then '__withdrawn__' else "
               + th("text", "coalesce(source_id, '')", "cast(authority as varchar)", sec("valid_from"), sec("valid_until"))
               + " end")


def status_at(now, stored="stored_status", vf="valid_from", vu="valid_until") -> str:
    return (f"case when {stored} <> 'active' then {stored} when {now} < {vf} then 'not_yet_valid' "
            f"when {now} >= {vu} then 'expired' else 'active' end")


# Two engines add doubles in different orders, so results are compared rounded to six places. Exact halves at
# the seventh place would then round either way; a tiny fixed offset on both sides moves them off the edge.
NUDGE = 1.2345e-9


def r6(x: str) -> str:
    return f"round({x} + {NUDGE}, 6) + 0.0"


def values(rows: list[tuple]) -> str:
    def lit(v):
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, str):
            return f"'{v}'"
        if isinstance(v, list):
            return "[" + ", ".join(lit(x) for x in v) + "]"
        if isinstance(v, float):
            return f"cast({v} as double)"
        return str(v)

    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


cte("ev_raw", """
  select event_id, user_id, event_type, cast(json_extract_string(props, '$.k') as int) as k,
         datediff('day', date '2024-01-01', cast(ts as date)) * cast(86400 as double) as day_start
  from events""")
cte("ev0", f"""
  select 't' || user_id as task_id, event_id as seq, 'r' || user_id || '-' || (event_id % 20) as record_id,
         k % 4 as revision, case when event_type <> 'error' then event_type || ' #' || k end as text,
         's' || (event_id % 3) as source_id, event_id % 3 as authority, day_start as valid_from,
         case when k % 5 = 0 then day_start + 604800 end as valid_until,
         case when k % 7 = 0 then ['p' || (k % 5)] end as about, event_id
  from ev_raw""")
cte("ev", f"""
  select * exclude (event_id), {PAYLOAD_KEY} as payload_key from (
    select * from ev0
    union all select * replace (seq + {D.REDELIVERED} as seq) from ev0 where event_id % 10 = 0
    union all select * replace (seq + {D.LATE_COPY} as seq, revision - 1 as revision) from ev0
              where event_id % 10 = 5 and revision > 0)""")
cte("cells", """
  select task_id, record_id, revision, payload_key, min(seq) as first_seq, first(text order by seq) as text,
         first(source_id order by seq) as source_id, first(authority order by seq) as authority,
         first(valid_from order by seq) as valid_from, first(valid_until order by seq) as valid_until
  from ev group by all""")
cte("state", """
  select *, case when n_payloads > 1 then 'conflicted' when payload_key = '__withdrawn__' then 'withdrawn'
                 else 'active' end as stored_status
  from (select *, count(*) over (partition by task_id, record_id) as n_payloads
        from (select * from cells
              qualify revision = max(revision) over (partition by task_id, record_id)))""")
cte("summary", """
  select task_id, record_id, max(revision) as revision, max(n_payloads) as n_payloads,
         max(stored_status) as stored_status, max(case when n_payloads = 1 then valid_from end) as valid_from,
         max(case when n_payloads = 1 then valid_until end) as valid_until
  from state group by 1, 2""")
cte("receipts0", """
  select *, max(revision) over (partition by task_id, record_id order by seq
                                rows between unbounded preceding and 1 preceding) as top_before,
         row_number() over (partition by task_id, record_id, revision, payload_key order by seq) as nth
  from ev""")
cte("receipts1", """
  select *, case when top_before is null or revision > top_before then 'applied'
                 when revision < top_before then 'stale' when nth = 1 then 'conflict' else 'duplicate' end as outcome
  from receipts0""")
cte("outcomes", """
  select * exclude (own),
         last_value(own ignore nulls) over (partition by task_id, record_id order by seq
                                            rows between unbounded preceding and current row) as status
  from (select *, outcome in ('applied', 'conflict') as changed,
               case when outcome = 'conflict' then 'conflicted'
                    when outcome = 'applied' and payload_key = '__withdrawn__' then 'withdrawn'
                    when outcome = 'applied' then 'active' end as own
        from receipts1)""")
cte("usable", f"""
  select * from state where {status_at(D.NOW)} = 'active' and coalesce(text, '') <> ''""")
cte("spans", """
  select task_id, record_id, revision, payload_key, status, seq as seq_from,
         lead(seq) over (partition by task_id, record_id order by seq) as seq_to,
         case when status = 'active' then text end as text,
         case when status = 'active' then authority end as authority,
         case when status = 'active' then valid_from end as valid_from
  from outcomes where changed""")
cte("tasks", "select distinct 't' || user_id as task_id from events")
cte("predicates", f"""
  select task_id, predicate_id, claim, prior, ask_cost, joint
  from tasks, (values {values(D.PREDICATES)}) as v(predicate_id, claim, prior, ask_cost, joint)""")
cte("gates", f"""
  select task_id, gate_id, op, children, k from tasks, (values {values(D.GATES)}) as v(gate_id, op, children, k)""")
cte("actions", f"""
  select task_id, action_id, description, requires, value_success, cost_failure, reliability, leak, needs_approval
  from tasks, (values {values(D.ACTIONS)}) as
  v(action_id, description, requires, value_success, cost_failure, reliability, leak, needs_approval)""")
T, BIAS = D.CALIBRATION
H = "('0x' || substr(sha256(text || '|' || predicate_id), 1, 8))::bigint"
cte("declared", """
  select task_id, record_id, first(about order by seq desc) as about from outcomes
  where outcome = 'applied' and about is not null group by 1, 2""")
cte("links", """
  select u.task_id, u.record_id, p.predicate_id, p.claim, p.joint, u.text, u.authority, u.valid_from, u.payload_key
  from usable u join predicates p using (task_id) left join declared d using (task_id, record_id)
  where d.about is null or list_contains(d.about, p.predicate_id)""")
cte("joint_pairs", """
  select task_id, predicate_id, claim, 'joint:' || predicate_id as record_id,
         string_agg(text, ' ' order by authority desc, valid_from desc, record_id) as text,
         max(authority) as authority, max(valid_from) as valid_from,
         string_agg(record_id, ',' order by authority desc, valid_from desc, record_id) as members
  from links where joint group by 1, 2, 3""")
cte("pairs", """
  select task_id, record_id, predicate_id, claim, text, authority, valid_from, record_id as members
  from links where not joint
  union all select task_id, record_id, predicate_id, claim, text, authority, valid_from, members from joint_pairs""")
PAIR = f"substr({th(chr(39) + 'pair' + chr(39), 'claim', 'text')}, 1, 24)"
cte("labelled", f"""
  select *, {PAIR} as pair, case when h % 10 < 3 then 0 when h % 10 < 5 then 1 else 2 end as label, 2 + (h // 16) % 5 as margin
  from (select *, {H} as h from pairs)""")
cte("logit", """
  select *, case when label = 0 then margin else 0 end as l0, case when label = 1 then margin else 0 end as l1,
         case when label = 2 then margin else 0 end as l2 from labelled""")


def softmax3(src: str, keep: str = "*", t: float = 1.0, bias=(0.0, 0.0, 0.0), logits=("l0", "l1", "l2")) -> str:
    z = [f"{x} / cast({t} as double) + {b}" for x, b in zip(logits, bias)]
    return f"""select {keep}, exp(z0 - zm) / zs as p_s, exp(z1 - zm) / zs as p_r, exp(z2 - zm) / zs as p_n from (
      select *, exp(z0 - zm) + exp(z1 - zm) + exp(z2 - zm) as zs from (
        select *, greatest(z0, z1, z2) as zm from (
          select *, {z[0]} as z0, {z[1]} as z1, {z[2]} as z2 from {src})))"""


cte("edges", softmax3("logit", "*", T, BIAS))
DECISION_KEYS = "task_id, predicate_id"


def precedence_sql(edges: str, keys: str = DECISION_KEYS) -> str:
    return f"""
    select {keys}, s / t as s, v / t as v, u / t as u, c / t as c from (
     select *, greatest(s + v + u + c, 1e-12) as t from (
      select {keys}, sum(bef * sup) as s, sum(bef * ref) as v, exp(sum(ln_none)) as u, sum(bef * con) as c from (
        select *, exp(coalesce(sum(ln_none) over (partition by {keys} order by authority desc, vf desc
                                 rows between unbounded preceding and 1 preceding), 0)) as bef from (
          select *, greatest(1 - none - sup - ref, 0) as con, ln(greatest(none, 1e-12)) as ln_none from (
            select {keys}, authority, vf, none, greatest(sn - none, 0) as sup, greatest(rn - none, 0) as ref from (
              select {keys}, authority, coalesce(valid_from, '-infinity'::double) as vf,
                     exp(sum(ln(greatest(p_n, 1e-12)))) as none, exp(sum(ln(greatest(p_s + p_n, 1e-12)))) as sn,
                     exp(sum(ln(greatest(p_r + p_n, 1e-12)))) as rn
              from {edges} group by all)))) group by all))"""


STATUS = ("case when s >= v and s >= u and s >= c then 'SATISFIED' when v >= u and v >= c then 'VIOLATED' "
          "when u >= c then 'UNRESOLVED' else 'CONFLICT' end")


def beliefs_sql(dist: str) -> str:
    return f"""select *, {STATUS} as status, s + (u + c) * prior as belief from (
      select p.task_id, p.predicate_id, p.prior, coalesce(s, 0) as s, coalesce(v, 0) as v, coalesce(u, 1) as u,
             coalesce(c, 0) as c
      from predicates p left join ({dist}) d using (task_id, predicate_id))"""


cte("beliefs", beliefs_sql(precedence_sql("edges")))


def leafrow_sql(source: str, keys: str = "task_id") -> str:
    cols = ", ".join(f"max(case when predicate_id = 'p{i}' then {e} end) as {n}{i}"
                     for i in range(5) for n, e in (("s", "s"), ("v", "v"), ("u", "u + c"), ("b", "belief")))
    return f"select {keys}, {cols} from {source} group by all"


def at_least_2(a: str, b: str, c: str) -> str:
    return f"({a} * {b} + {a} * {c} + {b} * {c} - 2 * {a} * {b} * {c})"


G0, G1 = ("(s0*s1)", "(1-(1-v0)*(1-v1))"), ("(1-(1-s2)*(1-s3))", "(v2*v3)")
NODES = {  # (satisfied, violated, belief) of each action's requirement, worked out by hand
    "a0": (at_least_2(G0[0], G1[0], "v4"), at_least_2(G0[1], G1[1], "s4"),
           at_least_2("(b0*b1)", "(1-(1-b2)*(1-b3))", "(1-b4)")),
    "a1": ("(s0*s1)", "(s0*v1 + v0 + u0*v1)", "(b0*b1)"),
    "a2": ("(s3 + v3*s2 + u3*s2)", "(v3*v2)", "(b3 + (1-b3)*b2)"),
}


def assess_sql(leafrow: str, keys: str = "task_id", ready: str = "0.5", block: str = "0.5") -> str:
    parts = " union all ".join(
        f"select {keys}, '{a}' as action_id, {s} as s, {v} as v, greatest(0, 1 - {s} - {v}) as u, {b} as belief from {leafrow}"
        for a, (s, v, b) in NODES.items())
    act = "(values " + values(D.ACTIONS) + ") as act(action_id, description, requires, val, cost, rel, leak, needs_approval)"
    return f"""select *, p_success * val - (1 - p_success) * cost as expected_utility,
      case when s >= {ready} and s >= v then 'READY' when v >= {block} then 'BLOCKED' else 'NEEDS_INFO' end as disposition
      from (select *, belief * rel + (1 - belief) * leak as p_success from ({parts}) join {act} using (action_id))"""


cte("leafrow", leafrow_sql("beliefs"))
cte("assessments", assess_sql("leafrow"))
