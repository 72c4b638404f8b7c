"""Alerts to playbooks to resolved actions, as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions.templates import fill_template, has_template

# The known actions and the parameters each one takes.
ACTIONS: Mapping[str, tuple[str, ...]] = {
    "isolate_host": ("ip_address", "quarantine_duration"),
    "block_ioc": ("iocs",),
    "collect_forensic_data": ("artifacts",),
    "alert_soc": ("severity", "recipients"),
}


def match_alerts(alerts: DataFrame, playbooks: DataFrame) -> DataFrame:
    """Each alert with each playbook that shares a trigger, once.

    The triggers on both sides are exploded and joined by equality. Only the alert key and the playbook name
    are made distinct; the wide columns are joined back afterwards.
    """
    wanted = playbooks.select(F.col("name").alias("playbook"), F.explode(F.array_distinct("triggers")).alias("trigger"))
    raised = alerts.select("alert_id", F.explode(F.array_distinct("triggers")).alias("trigger"))
    return raised.join(wanted, "trigger").select("alert_id", "playbook").distinct()


def unmatched_alerts(alerts: DataFrame, playbooks: DataFrame) -> DataFrame:
    """Alerts without any playbook, those without triggers included."""
    return alerts.join(match_alerts(alerts, playbooks), "alert_id", "left_anti")


def expand_actions(matches: DataFrame, playbooks: DataFrame) -> DataFrame:
    """One row per matched action in playbook order, counted from 1."""
    actions = playbooks.select(F.col("name").alias("playbook"), F.posexplode("actions").alias("at", "a"))
    actions = actions.select(
        "playbook",
        (F.col("at") + 1).alias("step"),
        F.col("a.name").alias("action"),
        F.col("a.type").alias("action_type"),
        F.col("a.parameters").alias("parameters"),
        F.col("a.priority").alias("priority"),
    )
    return matches.join(actions, "playbook")


def resolve_parameters(plan: DataFrame) -> DataFrame:
    """``resolved`` is the parameter map filled from ``context``; an entry is NULL when a key is missing.

    A parameter that is a JSON list of strings is filled element by element and written back as JSON.
    ``had_list_template`` marks actions with a template inside a list.
    """
    as_list = lambda v: F.when(v.startswith("["), F.from_json(v, "array<string>"))
    context = F.col("context")

    def filled(value):
        items = as_list(value)
        done = F.transform(items, lambda item: fill_template(item, context))
        whole = F.when(~F.exists(done, lambda item: item.isNull()), F.to_json(done))
        return F.when(items.isNotNull(), whole).otherwise(fill_template(value, context))

    templated = F.exists(
        F.map_values("parameters"),
        lambda v: F.coalesce(F.exists(as_list(v), lambda item: has_template(item)), F.lit(False)),
    )
    return plan.withColumns(
        {
            "resolved": F.transform_values("parameters", lambda k, v: filled(v)),
            "had_list_template": templated,
        }
    )


def action_status(plan: DataFrame, actions: Mapping[str, Sequence[str]] = ACTIONS) -> DataFrame:
    """``completed``, ``unknown`` (no such action) or ``failed`` (missing key or wrong parameters); never an error."""
    names = F.array_sort(F.map_keys("parameters"))
    fits = F.lit(False)
    for action, parameters in actions.items():
        expected = F.array(*[F.lit(p) for p in sorted(parameters)])
        fits = F.when(F.col("action") == action, names == expected).otherwise(fits)
    missing = F.exists(F.map_values("resolved"), lambda v: v.isNull())
    status = (
        F.when(~F.col("action").isin(*actions), "unknown").when(missing | ~fits, "failed").otherwise("completed")
    )
    return plan.withColumn("status", status)


def response_plan(alerts: DataFrame, playbooks: DataFrame) -> DataFrame:
    """Alerts through matching, expansion, resolution and status."""
    matched = match_alerts(alerts, playbooks)
    expanded = expand_actions(matched, playbooks).join(alerts.select("alert_id", "context"), "alert_id")
    return action_status(resolve_parameters(expanded)).select(
        "alert_id", "playbook", "step", "action", "action_type", "priority", "resolved", "had_list_template", "status"
    )


def write_plan(plan: DataFrame, path: str, batch: str | None = None) -> None:
    """Append the plan; carrying out an action is left to whoever reads it. A named batch is there once however often it is sent."""
    folder, mode = (path, "append") if batch is None else (f"{path}/batch={batch}", "overwrite")
    plan.withColumn("planned_at", F.current_timestamp()).write.mode(mode).json(folder)


def execute_playbook(requests: DataFrame, playbooks: DataFrame) -> DataFrame:
    """Requests ``(alert_id, playbook_id, context)`` run one named playbook: overall status and actions taken."""
    asked = requests.select("alert_id", F.col("playbook_id").alias("playbook"), "context")
    plan = action_status(resolve_parameters(expand_actions(asked, playbooks)))
    taken = F.array_sort(F.collect_list(F.when(F.col("status") == "completed", F.struct("step", "action"))))
    return plan.groupBy("alert_id", "playbook").agg(
        F.when(F.count_if(F.col("status") != "completed") == 0, "contained").otherwise("partial").alias("status"),
        F.transform(taken, lambda s: s["action"]).alias("actions_taken"),
    )
