"""Workflow templates: a fixed catalogue of requirements, instantiated from a table of parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The catalogue. {name} is the client, customer or version, {person} each listed person;
# a child written as prefix* stands for that predicate of every person.
TEMPLATE_IDS = ["client-handoff", "client-onboarding", "campaign-launch", "event-coordination", "support-followup",
                "software-release", "group-trip"]

DEFAULT_NAME = {
    "client-handoff": "the client", "client-onboarding": "the client", "campaign-launch": "the client",
    "support-followup": "the customer", "software-release": "the release build",
}
DEFAULT_PERSON = {"event-coordination": "the keynote speaker", "group-trip": "everyone"}

PREDICATES = [
    ("client-handoff", "design_approved", "{name} has approved the design that is being delivered.", 0.3, 0.3),
    ("client-handoff", "date_confirmed", "{name} has confirmed the delivery date.", 0.5, 0.3),
    ("client-handoff", "nda_signed", "The non-disclosure agreement has been signed by both parties.", 0.6, 0.5),
    ("client-handoff", "invoice_paid", "{name} has paid the invoice.", 0.4, 0.5),
    ("client-onboarding", "brief_received", "{name} has sent the project brief.", 0.3, 0.3),
    ("client-onboarding", "files_supplied", "{name} has supplied the files that were requested.", 0.3, 0.3),
    ("client-onboarding", "access_confirmed", "{name} has given access to the website or systems needed for the work.", 0.3, 0.3),
    ("client-onboarding", "kickoff_agreed", "{name} has agreed a date for the kickoff meeting.", 0.4, 0.2),
    ("campaign-launch", "copy_approved", "{name} has approved the final advertisement copy.", 0.3, 0.3),
    ("campaign-launch", "artwork_approved", "{name} has approved the final artwork.", 0.3, 0.3),
    ("campaign-launch", "materials_received", "All materials required for the launch have been received.", 0.3, 0.3),
    ("campaign-launch", "legal_cleared", "The legal or compliance review has cleared the campaign.", 0.5, 0.5),
    ("event-coordination", "venue_confirmed", "The venue has confirmed the booking in writing.", 0.4, 0.3),
    ("event-coordination", "equipment_confirmed", "The audio-visual equipment has been confirmed by the supplier.", 0.4, 0.3),
    ("event-coordination", "schedule_published", "The final schedule has been sent to all speakers.", 0.3, 0.2),
    ("support-followup", "fix_delivered", "The fix has been delivered to {name}.", 0.4, 0.3),
    ("support-followup", "replacement_received", "{name} has received the replacement.", 0.3, 0.3),
    ("support-followup", "customer_confirmed", "{name} has confirmed that the problem is resolved.", 0.3, 0.2),
    ("software-release", "tests_passed", "The test report for {name} shows that all required tests passed.", 0.4, 0.3),
    ("software-release", "notes_complete", "The release notes for {name} are complete.", 0.4, 0.2),
    ("software-release", "qa_signoff", "QA has signed off {name}.", 0.3, 0.3),
    ("software-release", "product_signoff", "The product owner has signed off {name}.", 0.3, 0.3),
    ("software-release", "rollback_ready", "A rollback plan for {name} has been written.", 0.5, 0.3),
    ("group-trip", "accommodation_booked", "The accommodation has been booked and confirmed.", 0.3, 0.3),
    ("group-trip", "transport_booked", "The transport has been booked and confirmed.", 0.3, 0.3),
]
PER_PERSON = [
    ("event-coordination", "speaker_", "{person} has confirmed they will speak at the event.", 0.5, 0.2),
    ("group-trip", "confirmed_", "{person} has confirmed they are coming.", 0.5, 0.2),
    ("group-trip", "contribution_", "{person} has paid their share.", 0.4, 0.2),
]
GATES = [
    ("client-handoff", "packet_ready", "AND", ["design_approved", "date_confirmed", "nda_signed"]),
    ("client-handoff", "invoice_paid_missing", "NOT", ["invoice_paid"]),
    ("client-onboarding", "ready_to_start", "AND", ["brief_received", "files_supplied", "access_confirmed"]),
    ("campaign-launch", "launch_ready", "AND", ["copy_approved", "artwork_approved", "materials_received", "legal_cleared"]),
    ("event-coordination", "enough_speakers", "ATLEAST", ["speaker_*"]),
    ("event-coordination", "announce_ready", "AND", ["venue_confirmed", "enough_speakers"]),
    ("event-coordination", "run_ready", "AND", ["venue_confirmed", "enough_speakers", "equipment_confirmed", "schedule_published"]),
    ("support-followup", "remedy", "OR", ["fix_delivered", "replacement_received"]),
    ("support-followup", "resolved", "AND", ["remedy", "customer_confirmed"]),
    ("software-release", "signoffs", "AND", ["qa_signoff", "product_signoff"]),
    ("software-release", "ship_ready", "AND", ["tests_passed", "notes_complete", "signoffs", "rollback_ready"]),
    ("group-trip", "enough_people", "ATLEAST", ["confirmed_*"]),
    ("group-trip", "all_paid", "AND", ["contribution_*"]),
    ("group-trip", "book_ready", "AND", ["enough_people"]),
    ("group-trip", "done", "AND", ["enough_people", "all_paid", "accommodation_booked", "transport_booked"]),
]
ACTIONS = [
    ("client-handoff", "send_packet", "Send the delivery packet to {name}", "packet_ready", 10.0, 25.0),
    ("client-handoff", "send_payment_reminder", "Remind {name} about the unpaid invoice", "invoice_paid_missing", 2.0, 5.0),
    ("client-onboarding", "start_work", "Start the work for {name}", "ready_to_start", 10.0, 25.0),
    ("client-onboarding", "hold_kickoff", "Hold the kickoff meeting with {name}", "kickoff_agreed", 5.0, 5.0),
    ("campaign-launch", "launch", "Launch the campaign", "launch_ready", 20.0, 60.0),
    ("event-coordination", "announce", "Announce the event publicly", "announce_ready", 10.0, 30.0),
    ("event-coordination", "run_event", "Run the event", "run_ready", 30.0, 80.0),
    ("support-followup", "close_ticket", "Close the ticket", "resolved", 5.0, 20.0),
    ("support-followup", "ask_customer", "Ask {name} whether the problem is resolved", "remedy", 2.0, 2.0),
    ("software-release", "ship", "Ship {name}", "ship_ready", 20.0, 100.0),
    ("group-trip", "book", "Make the bookings", "book_ready", 10.0, 30.0),
    ("group-trip", "send_itinerary", "Send the itinerary to everyone", "done", 5.0, 5.0),
]


def slug(c):
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", F.lit("x")).otherwise(s)


def _by_template(d: dict):
    out = F.lit("")
    for t, v in d.items():
        out = F.when(F.col("template_id") == t, F.lit(v)).otherwise(out)
    return out


def tasks_from_templates(params: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predicates, gates, actions) for rows (task_id, template_id, name, people, k). Empty names and lists take
    the template's default; k of 0 means everyone, and is kept within 1..number of people."""
    spark = params.sparkSession
    listed = F.filter(F.transform(F.coalesce("people", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    p = (params.withColumn("name", F.when(F.trim(F.coalesce("name", F.lit(""))) == "", _by_template(DEFAULT_NAME))
                           .otherwise(F.trim("name")))
         .withColumn("people", F.when(F.size(listed) > 0, listed).otherwise(F.array(_by_template(DEFAULT_PERSON)))))
    n = F.size("people")
    wanted = F.when(F.coalesce(F.col("k"), F.lit(0)) == 0, n).otherwise(F.col("k"))
    p = p.withColumn("k", F.greatest(F.lit(1), F.least(wanted, n)))

    def catalogue(rows, cols):
        return spark.createDataFrame(rows, cols)

    pcols = "template_id string, pid string, claim string, prior double, ask_cost double"
    fixed = (p.join(catalogue(PREDICATES, pcols), "template_id")
             .select("task_id", F.col("pid").alias("predicate_id"), F.replace("claim", F.lit("{name}"), F.col("name")).alias("text"),
                     "prior", "ask_cost"))
    each = (p.join(catalogue(PER_PERSON, pcols), "template_id").withColumn("person", F.explode("people"))
            .select("task_id", F.concat("pid", slug(F.col("person"))).alias("predicate_id"),
                    F.replace("claim", F.lit("{person}"), F.col("person")).alias("text"), "prior", "ask_cost"))
    predicates = fixed.unionByName(each).withColumn("join", F.lit(False))
    g = p.join(catalogue(GATES, "template_id string, gate_id string, op string, kids array<string>"), "template_id")
    kids = F.flatten(F.transform("kids", lambda c: F.when(
        c.endswith("*"), F.transform("people", lambda x: F.concat(F.replace(c, F.lit("*"), F.lit("")), slug(x)))).otherwise(F.array(c))))
    gates = g.select("task_id", "gate_id", "op", kids.alias("children"),
                     F.when(F.col("op") == "ATLEAST", F.col("k")).otherwise(F.lit(0)).alias("k"))
    a = p.join(catalogue(ACTIONS, "template_id string, action_id string, what string, requires string, value_success double, "
                                  "cost_failure double"), "template_id")
    actions = a.select("task_id", "action_id", F.replace("what", F.lit("{name}"), F.col("name")).alias("description"), "requires",
                       "value_success", "cost_failure", F.lit(1.0).alias("reliability"), F.lit(0.0).alias("leak"),
                       F.lit(False).alias("needs_approval"))
    return predicates, gates, actions


def expected_sql() -> str:
    """The same tables as one SQL statement over the derived parameter rows, for the check."""
    def rows(items):
        def lit(v):
            if isinstance(v, list):
                return "[" + ", ".join(lit(x) for x in v) + "]"
            return f"'{v}'" if isinstance(v, str) else f"{v}::double"
        return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in items)

    names = " ".join(f"when template_id = '{t}' then '{v}'" for t, v in DEFAULT_NAME.items())
    sl = "trim(regexp_replace(lower(person), '[^a-z0-9]+', '_', 'g'), '_')"
    par = f"""(select task_id, template_id, people, case when cid % 2 = 0 then 'Party ' || cid else case {names} else '' end end as name,
        case when k = 0 then len(people) else greatest(1, least(k, len(people))) end as k
      from (select *, substr(task_id, 2)::bigint as cid, [{', '.join(f"'{t}'" for t in TEMPLATE_IDS)}][substr(task_id, 2)::bigint % 7 + 1]
                   as template_id from conv_people))"""
    return f"""
      select task_id, 'predicate' as kind, pid as id, replace(claim, '{{name}}', name) as what, prior as x, cost as y
      from {par} join (values {rows(PREDICATES)}) as c(template_id, pid, claim, prior, cost) using (template_id)
      union all
      select task_id, 'predicate', pid || {sl}, replace(claim, '{{person}}', person), prior, cost
      from (select task_id, template_id, unnest(people) as person from {par})
      join (values {rows(PER_PERSON)}) as c(template_id, pid, claim, prior, cost) using (template_id)
      union all
      select task_id, 'gate', gid, op || ' ' || array_to_string(flatten(list_transform(kids, lambda c: case when c like '%*' then
        list_transform(people, lambda person: replace(c, '*', '') || {sl}) else [c] end)), ','),
        case when op = 'ATLEAST' then k else 0 end::double, 0.0
      from {par} join (values {rows(GATES)}) as c(template_id, gid, op, kids) using (template_id)
      union all
      select task_id, 'action', aid, replace(what, '{{name}}', name) || ' | ' || req, val, cost
      from {par} join (values {rows(ACTIONS)}) as c(template_id, aid, what, req, val, cost) using (template_id)"""
