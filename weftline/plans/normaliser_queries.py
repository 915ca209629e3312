"""Queries and checking SQL of the event normalisers, over calls that are made of the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import normalise
from weftline.plans.samples import table

#: Each domain's tools in the made calls: listed ones, and names that only a prefix or the changed state tells.
CALLED = {
    "calendar": "create_event update_event delete_event list_events find_slot",
    "shopping": "add_to_cart checkout get_order search_products reorder_items checkout",
    "banking": "transfer freeze_account verify_account get_balance wire_transfer audit",
    "email": "send_email add_label move_to_thread get_email get_thread forward_email",
    "filesystem": "mkdir rm chmod mv cp cat tar_create du",
    "payments": "pay_invoice refund_invoice create_invoice get_invoice create_webhook void",
    "crm": "create_lead convert_lead create_deal update_deal get_deal create_contact",
    "issue_tracker": "create_issue assign_issue transition_issue comment_issue get_issue close",
    "team_chat": "send_message create_thread react_message get_channel get_thread list_channels",
    "food_delivery": "create_order update_order_status cancel_order get_menu get_order rate_order",
}


def _case(of: str, values: list[str]) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_TOOL = "CASE " + " ".join(f"WHEN domain = '{d}' THEN {_case(f'n % {len(t.split())}', t.split())}" for d, t in CALLED.items()) + " END"
#: SQL that both engines know: texts only. a, b, c are small numbers of the row.
CALLS = f"""
WITH e AS (SELECT event_id, user_id % 7 AS a, event_id % 5 AS b, user_id % 3 AS c, event_id % 11 AS n, event_id % 10 AS d, value FROM events),
f AS (SELECT *, {_case('d', list(CALLED))} AS domain, (a + b) % 4 > 0 AS success, (a + c) % 2 = 0 AS state_changed FROM e),
g AS (SELECT *, CASE WHEN n = 10 THEN 'final_answer' ELSE 'tool_call' END AS action_type, CASE WHEN n = 10 THEN '' ELSE {_TOOL} END AS tool FROM f)
SELECT event_id, domain, action_type, tool, success, state_changed,
  CASE WHEN a = 6 AND b = 4 THEN 'no json' ELSE
  '{{"event_id":"E' || a || '","product_id":"P' || b || '","order_id":"O' || c || '","account_id":"A' || b || '","from_account":"A' || c || '","to_account":"A' || a ||
  '","owner_name":"' || CASE WHEN c = 0 THEN 'ann' WHEN c = 1 THEN 'BOB' ELSE '' END || CASE WHEN b < 3 THEN '","email_id":"M' || a ELSE '' END || '","thread_id":"T' || b ||
  CASE WHEN a = 0 THEN '' WHEN a = 1 THEN '","path":"' ELSE '","path":"/d' || a || CASE WHEN b = 1 THEN '/protected/' ELSE '/' END || 'f' || b END || '","source":"/s' || a || '","target":"/t' || b ||
  '","mode":"' || CASE WHEN c = 0 THEN '777' WHEN c = 1 THEN '0o644' ELSE 'u+x' END || '","invoice_id":"I' || a || '","url":"http://h/' || b || '","lead_id":"L' || a || '","deal_id":"D' || b ||
  CASE WHEN c > 0 THEN '","stage":"won' ELSE '' END || CASE WHEN b > 2 THEN '","amount":"5' ELSE '' END || '","issue_id":"S' || a || '","channel_id":"C' || b || '","message_id":"G' || a || '","restaurant_id":"R' || b ||
  '","fields":' || CASE WHEN c = 0 THEN '{{"start":1,"title":"x"}}' WHEN c = 1 THEN '{{"title":"y"}}' ELSE '[1]' END || '}}' END AS arguments,
  CASE WHEN b = 4 AND c = 2 THEN '"done"' WHEN b = 3 AND c = 2 THEN NULL
  WHEN (a + b) % 4 = 0 THEN '{{"error_message":"' || CASE (a + c) % 6 WHEN 0 THEN 'Invalid transition' WHEN 1 THEN 'invoice already paid' WHEN 2 THEN 'lead is lost' WHEN 3 THEN 'issue is Unassigned' WHEN 4 THEN 'channel not found' ELSE 'Cannot cancel now' END || '","old_mode":"644"}}'
  ELSE '{{"old_mode":"644","owner":"' || CASE WHEN a = 0 THEN '' ELSE 'Bob' END || '"' ||
    CASE c WHEN 0 THEN ',"event":{{"event_id":"E' || (a + 10) || '"}},"order":{{"order_id":"O' || (b + 10) || '"}},"transaction":{{"txn_id":"X' || a || '"}},"email":{{"email_id":"M' || (a + 20) || '"}},"payment":{{"payment_id":"Y' || b || '"}},"refund":{{"refund_id":"Z' || b || '"}},"invoice":{{"invoice_id":"I' || (a + 30) || '"}},"lead":{{"lead_id":"L' || (a + 5) || '"}},"contact":{{"contact_id":"N' || a || '"}},"deal":{{"deal_id":"D' || (b + 7) || '"}},"issue":{{"issue_id":"S' || (a + 8) || '"}},"message":{{"message_id":"G' || (a + 9) || '"}},"thread":{{"thread_id":"T' || (b + 9) || '"}}'
      WHEN 1 THEN ',"observation":{{"event_id":"E' || (a + 40) || '","order_id":"O' || (b + 40) || '"}},"txn_id":"X' || (a + 40) || '","email_id":"M' || (a + 40) || '","payment_id":"Y' || (b + 40) || '","lead_id":"L' || (a + 40) || '","issue_id":"S' || (a + 40) || '"'
      ELSE ',"event":"none","refund":"none","message":"none","contact":{{}},"order":{{}}' END || '}}' END AS observation,
  CASE WHEN a = 5 THEN NULL WHEN a = 4 AND b = 0 THEN '{{}}' WHEN a = 3 THEN '{{"events":{{"E1":{{}}}},"orders":{{"O1":{{}}}},"accounts":{{"A0":{{"frozen":false}},"A1":{{"frozen":0}}}}}}'
  ELSE '{{"calendar":{{"events":{{"E1":{{"t":1}},"E' || ((a + 4) % 7 + 2) || '":{{}}}}}},"shopping":{{"orders":{{"O1":{{"total":' || b || '}}}}}},"banking":{{"accounts":{{"A0":{{"frozen":false}},"A1":{{"frozen":false}},"A2":{{}},"A3":{{"frozen":true}}}}}}}}' END AS before,
  CASE WHEN b = 2 AND c = 0 THEN NULL WHEN a = 3 THEN '{{"events":{{"E1":{{}},"E9":{{}}}},"orders":{{}},"accounts":{{"A0":{{"frozen":1}},"A1":{{"frozen":"no"}}}}}}'
  ELSE '{{"calendar":{{"events":{{"E7":{{}},"E1":{{"t":' || c || '}},"E6":{{}}}}}},"shopping":{{"orders":{{"O1":{{"total":3}},"O' || (b + 10) || '":{{"total":[1,{{"x":' || a || '}}]}}}}}},"banking":{{"accounts":{{"A0":{{"frozen":' || CASE WHEN c = 1 THEN 'true' ELSE 'false' END || '}},"A1":{{"frozen":false}},"A2":{{"frozen":true}},"A3":{{}}}}}}}}' END AS after
FROM g
"""


def _calls(s, d):
    table(s, d, "events").createOrReplaceTempView("_made_of_events")
    return s.sql(CALLS.replace("FROM events)", "FROM _made_of_events)"))


def normalised_events(s, d):
    """Every call of the ten domains in common terms, with the progress that it makes."""
    out = normalise.normalised(_calls(s, d))
    joined = lambda c: F.array_join(c, ",").alias(c)
    met = normalise.predicates(F.col("operation"), F.col("action_type"), F.col("success"))
    return out.select("event_id", "operation", "target_type", "target_id", *map(joined, ("changed_fields", "created_ids", "deleted_ids")), "identity_violation", "forbidden_transition", F.array_join(met, ",").alias("met"))


def domain_policies(s, d):
    """Protected ids, budgets and identity policies of tasks of all domains."""
    own = F.col("event_id") % 4
    key = F.element_at(F.array(*[F.lit(x[3]) for x in normalise.DOMAINS]), (F.col("event_id") % 10 + 1).cast("int"))
    task = F.concat(F.lit('{"'), key, F.lit('":["P'), F.col("user_id").cast("string"), F.lit('","Q"]'), F.when(own == 1, ',"budget":9').otherwise(""), F.when(own == 2, ',"identity_policy":"verify"').otherwise(""), F.lit("}"))
    domain = F.element_at(F.array(*[F.lit(x[0]) for x in normalise.DOMAINS]), (F.col("event_id") % 10 + 1).cast("int"))
    tasks = table(s, d, "events").select("event_id", domain.alias("domain"), F.when(own == 3, "{}").otherwise(task).alias("task"))
    return normalise.task_policies(tasks).select("event_id", F.array_join("protected", ",").alias("protected"), "budget", "identity_policy")


def state_changes(s, d):
    """The leaves that a call changed in the state."""
    return normalise.state_changes(_calls(s, d).select("event_id", "before", "after"), "event_id")


QUERIES = {"normalised_events": normalised_events, "domain_policies": domain_policies, "state_changes": state_changes}

_S = lambda v, p: f"json_extract_string({v}, '$.{p}')"
_A, _O = (lambda k: _S("args", k)), (lambda k: _S("obs", k))


def _seen(first: str, second: str | None, key: str) -> str:
    """The id in the first of two places that is there; second '' is the observation."""
    other = "NULL" if second is None else f"json_extract_string(obs, '$.{second + '.' if second else ''}{key}')"
    return f"CASE WHEN NOT good THEN NULL WHEN json_exists(obs, '$.{first}') THEN json_extract_string(obs, '$.{first}.{key}') ELSE {other} END"


def _object(first: str) -> str:
    return f"(good AND (NOT json_exists(obs, '$.{first}') OR json_type(obs, '$.{first}') = 'OBJECT'))"


_FROZEN = lambda state, key: f"coalesce(json_extract({state}, '$.accounts.' || {_A(key)} || '.frozen')::VARCHAR NOT IN ('false', '0', 'null', '\"\"'), false)"
_NEW = lambda box, x, y: f"CASE WHEN both_known THEN array_to_string(list_sort(list_filter(coalesce(json_keys({x}, '$.{box}'), []), lambda k: NOT list_contains(coalesce(json_keys({y}, '$.{box}'), []), k))), ',') ELSE '' END"

ORACLE_SQL = {
    "normalised_events": f"""
WITH calls AS MATERIALIZED ({CALLS}),
p AS MATERIALIZED (
  SELECT *, CASE WHEN json_valid(arguments) THEN arguments::JSON END AS args, CASE WHEN json_type(observation) = 'OBJECT' THEN observation::JSON END AS obs,
    before IS NOT NULL AND after IS NOT NULL AND (domain <> 'shopping' OR (before <> '{{}}' AND after <> '{{}}')) AS both_known,
    CASE WHEN json_exists(before, '$.' || domain) THEN json_extract(before, '$.' || domain) ELSE before::JSON END AS b,
    CASE WHEN json_exists(after, '$.' || domain) THEN json_extract(after, '$.' || domain) ELSE after::JSON END AS s FROM calls),
q AS MATERIALIZED (SELECT *, success AND obs IS NOT NULL AS good, coalesce(CASE WHEN NOT success THEN {_O('error_message')} END, '') AS error,
        coalesce(nullif({_A('path')}, ''), {_A('source')}, '') AS file FROM p),
r AS MATERIALIZED (
  SELECT *,
    CASE WHEN action_type <> 'tool_call' AND domain <> 'banking' THEN 'terminal'
      WHEN tool = 'cd' THEN 'navigate'
      WHEN tool IN ('add_to_cart', 'remove_from_cart', 'cancel_order', 'transfer', 'freeze_account', 'add_label', 'move_to_thread', 'mv', 'chmod', 'convert_lead', 'assign_issue', 'transition_issue', 'comment_issue', 'update_deal', 'update_event', 'update_order_status', 'react_message', 'reorder_items', 'wire_transfer', 'rate_order') THEN 'update'
      WHEN tool IN ('create_event', 'checkout', 'send_email', 'forward_email', 'mkdir', 'cp', 'tar_create', 'pay_invoice', 'refund_invoice', 'create_invoice', 'create_webhook', 'create_lead', 'create_deal', 'create_contact', 'create_issue', 'send_message', 'create_thread', 'create_order') THEN 'create'
      WHEN tool IN ('delete_event', 'rm') THEN 'delete'
      WHEN regexp_matches(tool, '^(get|list|search|find|verify)_') OR tool = 'cat' THEN 'query'
      WHEN state_changed THEN 'update' ELSE 'query' END AS operation,
    CASE domain WHEN 'calendar' THEN 'calendar_event'
      WHEN 'shopping' THEN CASE WHEN action_type <> 'tool_call' THEN '' WHEN tool = 'search_products' THEN 'product' WHEN tool = 'add_to_cart' THEN 'shopping_cart' WHEN tool IN ('checkout', 'get_order') THEN 'shopping_order' ELSE 'shopping_resource' END
      WHEN 'banking' THEN 'bank_account' WHEN 'email' THEN CASE WHEN tool IN ('move_to_thread', 'get_thread') THEN 'email_thread' ELSE 'email' END
      WHEN 'filesystem' THEN CASE WHEN tool = 'mkdir' THEN 'directory' ELSE 'file' END
      WHEN 'payments' THEN CASE tool WHEN 'pay_invoice' THEN 'payment' WHEN 'refund_invoice' THEN 'refund' WHEN 'create_webhook' THEN 'webhook' ELSE 'invoice' END
      WHEN 'crm' THEN CASE WHEN tool LIKE '%deal' THEN 'deal' WHEN tool = 'create_contact' THEN 'contact' ELSE 'lead' END
      WHEN 'issue_tracker' THEN 'issue'
      WHEN 'team_chat' THEN CASE WHEN tool IN ('get_channel', 'list_channels') THEN 'channel' WHEN tool LIKE '%thread' THEN 'thread' ELSE 'message' END
      ELSE CASE WHEN tool = 'get_menu' THEN 'restaurant' ELSE 'order' END END AS target_type,
    coalesce(CASE WHEN action_type <> 'tool_call' AND domain <> 'banking' THEN ''
      WHEN tool = 'create_event' THEN {_seen('event', 'observation', 'event_id')} WHEN tool = 'update_event' THEN coalesce({_seen('event', 'observation', 'event_id')}, {_A('event_id')}) WHEN tool = 'delete_event' THEN {_A('event_id')}
      WHEN tool = 'add_to_cart' THEN {_A('product_id')} WHEN tool = 'checkout' THEN {_seen('order', 'observation', 'order_id')}
      WHEN domain = 'shopping' AND tool = 'get_order' THEN {_A('order_id')}
      WHEN tool = 'transfer' THEN {_A('from_account')} WHEN domain = 'banking' THEN {_A('account_id')}
      WHEN tool = 'send_email' THEN {_seen('email', '', 'email_id')} WHEN tool IN ('add_label', 'move_to_thread') THEN {_A('email_id')}
      WHEN domain = 'email' AND tool IN ('get_email', 'get_thread') THEN coalesce({_A('email_id')}, {_A('thread_id')})
      WHEN tool = 'mv' THEN {_A('source')} WHEN tool = 'cp' THEN {_A('target')} WHEN domain = 'filesystem' THEN file
      WHEN tool IN ('pay_invoice', 'refund_invoice', 'get_invoice') THEN {_A('invoice_id')} WHEN tool = 'create_invoice' THEN {_seen('invoice', '', 'invoice_id')} WHEN tool = 'create_webhook' THEN {_A('url')}
      WHEN tool = 'create_lead' THEN {_seen('lead', '', 'lead_id')} WHEN tool = 'convert_lead' THEN {_A('lead_id')} WHEN tool = 'create_deal' THEN {_seen('deal', '', 'deal_id')} WHEN tool IN ('update_deal', 'get_deal') THEN {_A('deal_id')}
      WHEN tool = 'create_issue' THEN {_seen('issue', '', 'issue_id')} WHEN tool IN ('assign_issue', 'transition_issue', 'comment_issue', 'get_issue') THEN {_A('issue_id')}
      WHEN tool IN ('send_message', 'get_channel') THEN {_A('channel_id')} WHEN tool IN ('create_thread', 'react_message') THEN {_A('message_id')} WHEN domain = 'team_chat' AND tool = 'get_thread' THEN {_A('thread_id')}
      WHEN tool = 'create_order' THEN {_seen('order', '', 'order_id')} WHEN tool IN ('update_order_status', 'cancel_order', 'get_order') THEN {_A('order_id')} WHEN tool = 'get_menu' THEN {_A('restaurant_id')} END, '') AS target_id,
    coalesce(CASE tool WHEN 'update_event' THEN array_to_string(json_keys(CASE WHEN json_type(args, '$.fields') = 'OBJECT' THEN json_extract(args, '$.fields') ELSE '{{}}' END), ',')
      WHEN 'transfer' THEN CASE WHEN both_known THEN 'balance' END WHEN 'freeze_account' THEN CASE WHEN both_known AND NOT {_FROZEN('b', 'account_id')} AND {_FROZEN('s', 'account_id')} THEN 'frozen' END
      WHEN 'send_email' THEN 'inbox,thread' WHEN 'add_label' THEN 'labels' WHEN 'move_to_thread' THEN 'thread_id' WHEN 'chmod' THEN 'permissions' WHEN 'mv' THEN 'path' WHEN 'pay_invoice' THEN 'status,payment_id' WHEN 'refund_invoice' THEN 'status,refund_id'
      WHEN 'convert_lead' THEN 'status' WHEN 'update_deal' THEN concat_ws(',', CASE WHEN json_exists(args, '$.stage') THEN 'stage' END, CASE WHEN json_exists(args, '$.amount') THEN 'amount' END)
      WHEN 'assign_issue' THEN 'assignee' WHEN 'transition_issue' THEN 'state' WHEN 'react_message' THEN 'reactions' WHEN 'update_order_status' THEN 'status' WHEN 'cancel_order' THEN 'status,cancel_reason' END, '') AS changed_fields,
    coalesce(CASE WHEN tool = 'create_event' THEN {_NEW('events', 's', 'b')} WHEN tool = 'checkout' THEN {_NEW('orders', 's', 'b')}
      WHEN tool = 'transfer' THEN CASE WHEN both_known THEN {_seen('transaction', '', 'txn_id')} END WHEN tool = 'send_email' THEN {_seen('email', '', 'email_id')}
      WHEN tool = 'mkdir' THEN CASE WHEN success THEN file END WHEN tool = 'cp' THEN {_A('target')}
      WHEN tool = 'pay_invoice' THEN {_seen('payment', '', 'payment_id')} WHEN tool = 'refund_invoice' THEN CASE WHEN {_object('refund')} THEN {_seen('refund', '', 'refund_id')} END
      WHEN tool = 'convert_lead' THEN {_seen('contact', None, 'contact_id')} WHEN tool = 'send_message' THEN CASE WHEN {_object('message')} THEN {_seen('message', '', 'message_id')} END
      WHEN tool = 'create_thread' THEN {_seen('thread', '', 'thread_id')} WHEN tool = 'create_order' THEN {_seen('order', '', 'order_id')} END, '') AS created_ids,
    coalesce(CASE tool WHEN 'delete_event' THEN {_NEW('events', 'b', 's')} WHEN 'rm' THEN CASE WHEN success THEN file END END, '') AS deleted_ids,
    CASE WHEN tool = 'verify_account' AND {_A('owner_name')} <> '' AND {_O('owner')} <> '' AND lower({_A('owner_name')}) <> lower({_O('owner')}) THEN 'identity_or_provenance_violation' ELSE '' END AS identity_violation,
    coalesce(CASE tool WHEN 'transfer' THEN CASE WHEN both_known AND ({_FROZEN('s', 'from_account')} OR {_FROZEN('s', 'to_account')}) THEN 'transfer_to_or_from_frozen_account' END
      WHEN 'freeze_account' THEN CASE WHEN both_known AND NOT {_FROZEN('b', 'account_id')} AND {_FROZEN('s', 'account_id')} THEN 'unauthorized_freeze' END
      WHEN 'rm' THEN CASE WHEN contains(file, '/protected/') THEN 'deleting_protected_path' END WHEN 'chmod' THEN CASE WHEN {_A('mode')} = '777' AND {_O('old_mode')} = '644' THEN 'permission_escalation' END
      WHEN 'pay_invoice' THEN CASE WHEN contains(error, 'already paid') THEN 'double_payment' END WHEN 'convert_lead' THEN CASE WHEN contains(error, 'lost') THEN 'convert_lost_lead' END
      WHEN 'transition_issue' THEN CASE WHEN error = 'Invalid transition' THEN 'invalid_workflow_transition' WHEN error = 'issue is Unassigned' THEN 'transition_unassigned_issue' END
      WHEN 'send_message' THEN CASE WHEN contains(error, 'not found') THEN 'send_to_nonexistent_channel' END WHEN 'update_order_status' THEN CASE WHEN error = 'Invalid transition' THEN 'lifecycle_stage_skip' END
      WHEN 'cancel_order' THEN CASE WHEN error = 'Cannot cancel now' THEN 'cancel_after_preparing' END END, '') AS forbidden_transition
  FROM q)
SELECT event_id, operation, target_type, target_id, changed_fields, created_ids, deleted_ids, identity_violation, forbidden_transition,
  CASE WHEN NOT success THEN '' ELSE concat_ws(',', CASE WHEN operation IN ('create', 'update', 'delete') THEN 'completed_required_transition' END, CASE WHEN operation IN ('query', 'create', 'update', 'delete') THEN 'resolved_required_entity' END,
    CASE WHEN action_type = 'final_answer' THEN 'verified_postcondition,produced_required_response' END) END AS met
FROM r""",
    "domain_policies": """
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN '' ELSE 'P' || user_id || ',Q' END AS protected,
  CASE WHEN event_id % 4 = 1 THEN 9 ELSE [5, 4, 6, 5, 8, 5, 6, 6, 4, 5][event_id % 10 + 1] END::BIGINT AS budget,
  CASE WHEN event_id % 4 = 2 THEN 'verify' ELSE ['preserve', 'create_new', 'preserve', 'append_only', 'preserve', 'verify', 'preserve', 'preserve', 'append_only', 'create_new'][event_id % 10 + 1] END AS identity_policy
FROM events""",
    "state_changes": f"""
WITH calls AS MATERIALIZED ({CALLS}),
l AS (
  SELECT event_id, 0 AS side, fullkey, atom FROM calls, json_tree(before::JSON) WHERE before IS NOT NULL AND (type NOT IN ('OBJECT', 'ARRAY') OR value::VARCHAR IN ('{{}}', '[]'))
  UNION ALL
  SELECT event_id, 1, fullkey, atom FROM calls, json_tree(after::JSON) WHERE after IS NOT NULL AND (type NOT IN ('OBJECT', 'ARRAY') OR value::VARCHAR IN ('{{}}', '[]'))),
m AS (SELECT event_id, fullkey AS path, max(CASE WHEN side = 0 THEN coalesce(atom::VARCHAR, '{{}}') END) AS before, max(CASE WHEN side = 1 THEN coalesce(atom::VARCHAR, '{{}}') END) AS after FROM l GROUP BY 1, 2)
SELECT event_id, path, before, after FROM m WHERE before IS DISTINCT FROM after""",
}
