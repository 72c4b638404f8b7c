"""Alerts and playbooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.operators import response
from palisade.plans import fixtures as fx
from palisade.plans.registry import query
from palisade.storage import scratch_path

_BOOKS = f"{fx.cte('books', fx.PLAYBOOK_COLUMNS, fx.PLAYBOOKS)}, {fx.cte('steps', fx.ACTION_COLUMNS, fx.ACTIONS)}"
_MATCHED = f"""{fx.ALERTS}, {_BOOKS}, matched AS (SELECT DISTINCT alert_id, playbook
  FROM (SELECT alert_id, unnest(triggers) AS trigger FROM alerts) JOIN (SELECT playbook, unnest(string_split(triggers, '|')) AS trigger FROM books) USING (trigger))"""
# The templates of the fixture playbooks, filled; NULL where a key is missing.
_FILLED = f"""{_MATCHED}, filled AS (SELECT alert_id, playbook, step, action, action_type, priority,
    CASE WHEN action = 'isolate_host' THEN source_ip WHEN action = 'stop_backups' THEN source_ip
      WHEN action = 'collect_forensic_data' THEN '["open_files"]' WHEN action = 'alert_soc' THEN '["night-desk@example.net","lead@example.net"]'
      WHEN action = 'block_ioc' THEN '["' || c2_server || '","' || malicious_hash || '","' || source_ip || '"]' END AS main,
    contains(parameters, 'malicious_hash') AS had_list_template,
    CASE WHEN action = 'stop_backups' THEN 'unknown' WHEN action = 'block_ioc' AND c2_server IS NULL THEN 'failed'
      WHEN action = 'isolate_host' AND NOT contains(parameters, 'quarantine_duration') THEN 'failed' ELSE 'completed' END AS status
  FROM matched JOIN alerts USING (alert_id) JOIN steps USING (playbook))"""


@query("alert_playbook_matches", f"WITH {_MATCHED} SELECT * FROM matched")
def alert_playbook_matches(spark, sf):
    return response.match_alerts(fx.alerts(spark, sf), fx.playbooks(spark))


@query("unmatched_alerts", f"WITH {_MATCHED} SELECT alert_id FROM alerts WHERE alert_id NOT IN (SELECT alert_id FROM matched)")
def unmatched_alerts(spark, sf):
    return response.unmatched_alerts(fx.alerts(spark, sf), fx.playbooks(spark)).select("alert_id")


@query(
    "playbook_actions",
    f"WITH {_MATCHED} SELECT alert_id, playbook, step, action, action_type, coalesce(priority, '') AS priority FROM matched JOIN steps USING (playbook)",
)
def playbook_actions(spark, sf):
    playbooks = fx.playbooks(spark)
    actions = response.expand_actions(response.match_alerts(fx.alerts(spark, sf), playbooks), playbooks)
    return actions.select("alert_id", "playbook", "step", "action", "action_type", F.coalesce("priority", F.lit("")).alias("priority"))


def _plan(spark, sf):
    return response.response_plan(fx.alerts(spark, sf), fx.playbooks(spark))


def _main_parameter():
    return F.coalesce(*[F.try_element_at("resolved", F.lit(k)) for k in ("ip_address", "host", "artifacts", "iocs", "recipients")])


@query("resolved_parameters", f"WITH {_FILLED} SELECT alert_id, playbook, step, coalesce(main, '') AS main, had_list_template FROM filled")
def resolved_parameters(spark, sf):
    return _plan(spark, sf).select("alert_id", "playbook", "step", F.coalesce(_main_parameter(), F.lit("")).alias("main"), "had_list_template")


@query("action_status", f"WITH {_FILLED} SELECT alert_id, playbook, step, action, status FROM filled")
def action_status(spark, sf):
    return _plan(spark, sf).select("alert_id", "playbook", "step", "action", "status")


@query(
    "action_plan_sink",
    f"WITH {_FILLED} SELECT action, status, coalesce(priority, '') AS priority, count(*) AS planned, count(main) AS with_parameter FROM filled GROUP BY ALL",
)
def action_plan_sink(spark, sf):
    path = scratch_path(spark, "response-plan")
    response.write_plan(_plan(spark, sf), path)
    stored = spark.read.schema(
        "alert_id long, playbook string, step int, action string, priority string, resolved map<string,string>, status string, planned_at timestamp"
    ).json(path)
    return stored.groupBy("action", "status", F.coalesce("priority", F.lit("")).alias("priority")).agg(
        F.count("planned_at").alias("planned"), F.count(_main_parameter()).alias("with_parameter")
    )


@query(
    "playbook_execution",
    f"""WITH {fx.ALERTS}, {_BOOKS}, asked AS (SELECT *, CASE WHEN alert_id % 3 = 0 THEN 'Locked files' ELSE 'First hour' END AS playbook FROM alerts)
    SELECT alert_id, playbook, CASE WHEN playbook = 'First hour' AND c2_server IS NOT NULL THEN 'contained' ELSE 'partial' END AS status,
      CASE WHEN playbook = 'Locked files' THEN 'collect_forensic_data' WHEN c2_server IS NULL THEN 'alert_soc|isolate_host'
        ELSE 'alert_soc|block_ioc|isolate_host' END AS actions_taken FROM asked""",
)
def playbook_execution(spark, sf):
    name = F.when(F.col("alert_id") % 3 == 0, "Locked files").otherwise("First hour")
    requests = fx.alerts(spark, sf).withColumn("playbook_id", name)
    done = response.execute_playbook(requests, fx.playbooks(spark))
    return done.withColumn("actions_taken", F.array_join("actions_taken", "|"))
