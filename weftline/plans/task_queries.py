"""Queries and checking SQL of tasks, loosely typed values, LaTeX answers and policy corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import answers, arrays, contracts, jsons, maths
from weftline.functions import text as tx
from weftline.operators import advantages as adv
from weftline.operators import policy, retrieval, tasks
from weftline.plans.samples import SAMPLES_SQL, rounded, samples, table
from weftline.plans.trajectory_log import LOG_SQL, event_log, session_tasks
from weftline.sources import io


def _calls(s, d):
    """The calls of audited sessions as tasks; every tenth task has no end action."""
    e = event_log(s, d)
    return e.where("not (action_type <> 'tool_call' and session % 10 = 7)").select(
        F.col("session").alias("task"), F.col("step").alias("i"), F.col("action_type").alias("action"), F.when(F.col("action_type") == "tool_call", F.col("tool_name")).otherwise(F.col("action_type")).alias("tool_name"), "arguments")


def _packed(s, d):
    """A row a task with its calls in order."""
    call = F.struct("tool_name", "arguments", "action")
    rows = F.collect_list(F.struct("i", F.hash("tool_name").alias("h"), call.alias("c")))
    by_i = F.transform(F.sort_array(F.transform(rows, lambda r: F.struct(r["i"], r["h"], F.to_json(r["c"]).alias("c")))), lambda r: F.from_json(r["c"], "struct<tool_name:string,arguments:map<string,string>,action:string>"))
    n = F.col("task") % 10
    words = F.element_at(F.array(*map(F.lit, ("show my orders", "please create a new order", "update and delete the note", "what is the status", "cancel it"))), (F.col("task") % 5 + 1).cast("int"))
    return _calls(s, d).groupBy("task").agg(by_i.alias("calls")).withColumns({
        "scenario": F.when(n == 0, "no_tool_or_abstention").otherwise("normal_safe_success"), "method": F.when(n == 1, "irrelevant_template").otherwise("plan"), "missing": n < 2,
        "hidden": F.when(n < 2, F.array(F.lit("create_order"))).otherwise(F.array().cast("array<string>")), "query": words, "rounds": (F.col("task") % 7).cast("int"),
        "domain": F.when(n < 4, "orders").otherwise("items"), "required": F.array(F.lit("get_order"), F.lit("update_order")),
    })


def progress_predicates(s, d):
    return tasks.progress_predicates(_calls(s, d))


def target_ids(s, d):
    return tasks.target_ids(_calls(s, d))


def deleted_target_ids(s, d):
    return tasks.target_ids(_calls(s, d), deleting=True)


def training_oracle(s, d):
    return tasks.training_oracle(_calls(s, d)).select("task", "i", "tool_name", "error")


def _states(s, d):
    o = table(s, d, "orders").select((F.col("o_orderkey") % 200).alias("task"), F.lit("orders").alias("container"), F.col("o_orderkey").cast("string").alias("entity"), "o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").cast("string").alias("cust_id"))
    fields = lambda df: df.select("task", "container", "entity", F.explode(F.create_map(*[x for c in ("status", "priority", "cust_id") for x in (F.lit(c), F.col(c))])).alias("field", "value"))
    moved = F.when(F.col("o_totalprice") > 300000, F.lit("X")).otherwise(F.col("status"))
    return fields(o.where("o_orderkey % 5 <> 0")), fields(o.where("o_orderkey % 7 <> 0").withColumn("status", moved).withColumn("priority", F.when(F.col("o_totalprice") < 2000, F.lit(None)).otherwise(F.col("priority"))))


def derived_criteria(s, d):
    return tasks.derived_criteria(*_states(s, d))


def protected_fields(s, d):
    before, after = _states(s, d)
    targets = before.select("task", F.col("entity").alias("id")).where("cast(id as bigint) % 3 = 0").distinct()
    return tasks.protected_fields(before, targets, tasks.derived_criteria(before, after))


def task_checks(s, d):
    return tasks.task_checks(_packed(s, d))


def dataset_checks(s, d):
    t = _packed(s, d)
    return tasks.dataset_checks(t, t.where("task % 3 = 0"))


def hidden_tools(s, d):
    return tasks.without_last_tool(_packed(s, d)).select("task", "hidden", F.col("scenario"), F.size("calls").alias("n"))


def task_scenarios(s, d):
    o = table(s, d, "orders")
    kind = F.when(F.col("o_orderkey") % 4 == 0, "missing_function").when(F.col("o_orderkey") % 4 == 1, "irrelevant").otherwise("multi")
    return o.select("o_orderkey", tasks.task_scenario(F.when(F.col("o_orderkey") % 5 == 0, F.lit("tool_error_recovery")), kind).alias("scenario"), tasks.identity_policy(F.element_at(F.array(*map(F.lit, ("calendar", "email", "shopping", "filesystem", "other"))), (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("policy"))


def scenario_rules(s, d):
    t = _packed(s, d).withColumn("tools", F.transform(F.filter("calls", lambda c: c["action"] == "tool_call"), lambda c: F.replace(c["tool_name"], F.lit("_order"), F.lit("_event"))))
    end = F.when(F.col("task") % 6 == 0, "ask_clarification").otherwise("final_answer")
    return t.select("task", contracts.scenario(F.when(F.col("task") % 12 == 0, F.slice("tools", F.lit(1), F.lit(0))).otherwise(F.col("tools")), end, F.col("task") % 11 == 0, F.lit("calendar")).alias("scenario"))


def contract_errors(s, d):
    t = _packed(s, d)
    q = F.when(F.col("task") % 9 == 0, F.lit("by 2024-01-05")).otherwise(F.col("query"))
    return t.select("task", io.contract_error(F.transform("calls", lambda c: F.struct(c["action"].alias("action"))), F.col("scenario"), q).alias("error"))


def intents(s, d):
    """Read and write intent over whole turns, with a request added to some."""
    k = F.col("conv_id") % 5
    t = F.concat("text", F.when(k == 0, " Please show the agenda").when(k == 1, " please re-send it").when(k == 2, " run export data now").otherwise(""))
    tool = F.when(k == 1, "send_email").when(k == 2, "export_data").when(k == 3, "delete_order").otherwise("create_event")
    return table(s, d, "conversations").select("conv_id", "turn", tasks.read_intent(t).alias("reads"), tasks.write_intent(t, tool).alias("writes"), tasks.needed_tool(t, tool, F.col("turn") % 2 == 0, k < 3).alias("needed"))


def tool_entities(s, d):
    name = F.concat(F.element_at(F.array(*map(F.lit, ("get_order", "send_email", "list_issues", "mkdir", "add_reaction"))), (F.col("event_id") % 5 + 1).cast("int")), F.when(F.col("event_id") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("_"), F.col("event_type"))))
    return table(s, d, "events").select("event_id", tasks.tool_entity(name).alias("entity"))


def _schemas(s, d):
    n = table(s, d, "nation")
    names = F.array(F.concat(F.lit("id"), (F.col("n_nationkey") % 7).cast("string")), F.concat(F.lit("k"), F.col("n_regionkey").cast("string")))
    need = F.array(F.concat(F.lit("id"), ((F.col("n_nationkey") + 1) % 11).cast("string")))
    tool = F.concat(F.element_at(F.array(*map(F.lit, ("get_order_", "send_email_", "x_item_"))), (F.col("n_nationkey") % 3 + 1).cast("int")), F.col("n_nationkey").cast("string"))
    return n.select(tool.alias("tool"), names.alias("outputs"), need.alias("required"), (F.col("n_nationkey") % 9).alias("name_no"), F.concat(F.lit("s"), F.col("n_regionkey").cast("string")).alias("server"), F.col("n_nationkey").alias("nth"))


def schema_edges(s, d):
    return tasks.schema_edges(_schemas(s, d))


def routed_calls(s, d):
    schemas = _schemas(s, d).select(F.concat(F.lit("t"), F.col("name_no").cast("string")).alias("tool"), "server", "required", "nth")
    calls = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("t"), (F.col("o_orderkey") % 11).cast("string")).alias("tool"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("s"), (F.col("o_orderkey") % 5).cast("string"))).alias("domain"), F.array(F.concat(F.lit("id"), (F.col("o_custkey") % 12).cast("string"))).alias("keys"))
    return tasks.routed(calls, schemas)


def fuzzy_tools(s, d):
    names = table(s, d, "events").select(F.concat(F.element_at(F.array(*map(F.lit, ("GET_", "get_", "my_", "x "))), (F.col("event_id") % 4 + 1).cast("int")), F.col("event_type"), F.when(F.col("event_id") % 3 == 0, "s").otherwise("")).alias("raw"))
    valid = s.createDataFrame([("get_click",), ("view",), ("get_my_purchase",), ("signup_now",)], "tool string")
    return tasks.fuzzy_matches(names, valid)


def distractors(s, d):
    t = table(s, d, "customer").select(F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("task"), F.array("c_mktsegment").alias("known"))
    registry = table(s, d, "part").select(F.col("p_type").alias("tool")).unionByName(table(s, d, "customer").select(F.col("c_mktsegment").alias("tool")))
    return tasks.with_distractors(t, registry)


def minimal_arguments(s, d):
    k = F.col("p_partkey") % 7
    kind = F.element_at(F.array(*map(F.lit, ("string", "integer", "number", "boolean", "array", "object", "other"))), (k + 1).cast("int"))
    return table(s, d, "part").select("p_partkey", tasks.minimal_arguments(kind, F.when(F.col("p_partkey") % 5 == 0, F.array("p_brand")).otherwise(F.array().cast("array<string>"))).alias("value"))


def argument_errors(s, d):
    k = F.col("event_id") % 4
    args = F.when(k == 0, F.create_map(F.lit("id"), F.lit('"a"'), F.lit("n"), F.lit("3"))).when(k == 1, F.create_map(F.lit("id"), F.lit("7"), F.lit("kind"), F.lit('"x"'))).when(k == 2, F.create_map(F.lit("n"), F.lit("2.5"), F.lit("zz"), F.lit("true"))).otherwise(F.create_map(F.lit("id"), F.lit('"b"'), F.lit("kind"), F.lit('"fast"')))
    types = F.create_map(*[F.lit(x) for x in ("id", "string", "n", "integer", "kind", "string")])
    e = contracts.argument_errors(args, types, F.array(F.lit("id"), F.lit("n")), F.create_map(F.lit("kind"), F.array(F.lit('"fast"'), F.lit('"slow"'))))
    return table(s, d, "events").select("event_id", e.alias("e")).select("event_id", *[F.array_join(F.array_sort(f"e.{c}"), ",").alias(c) for c in ("missing", "unexpected", "type_errors", "enum_errors")])


def deletable_customers(s, d):
    return tasks.deletable(table(s, d, "customer"), "c_custkey", table(s, d, "orders").where("o_totalprice > 200000"), "o_custkey").select("c_custkey", "error")


def task_stats(s, d):
    t = session_tasks(s, d).withColumns({"domain": F.when(F.col("session") % 3 == 0, "orders").otherwise("items"), "scenario": F.when(F.col("session") % 10 == 0, "idle").otherwise("busy"), "criteria": F.when(F.col("session") % 4 == 0, F.slice("criteria", F.lit(1), F.lit(0))).otherwise(F.col("criteria"))})
    return tasks.stats_report(t, "domain", "scenario").select(F.coalesce("domain", F.lit("all")).alias("domain"), F.coalesce("scenario", F.lit("all")).alias("scenario"), "n", "empty_criteria")


def trace_summary(s, d):
    return tasks.trace_summary(event_log(s, d).withColumn("failed", ~F.col("execution_success")), "session", "failed", "tool_name")


def chain_progress(s, d):
    t = _packed(s, d)
    names = F.transform(F.filter("calls", lambda c: c["action"] == "tool_call"), lambda c: c["tool_name"])
    return t.select("task", tasks.chain_progress(names, F.array(F.lit("get_order"), F.lit("list_items"), F.lit("get_order"))).alias("met"))


def batch_diagnosis(s, d):
    return tasks.batch_diagnosis(samples(s, d), "uid")


def tree_listing(s, d):
    return tasks.tree_listing(table(s, d, "documents").select(F.concat(F.lit("/"), F.col("lang"), F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("path")), 2)


def typed_equality(s, d):
    k, v = F.col("event_id") % 6, F.round("value", 2).cast("string")
    a = F.when(k == 0, v).when(k == 1, F.concat(F.lit(" "), F.upper("event_type"))).when(k == 2, F.lit('{"b": 1, "a": [2, 3]}')).when(k == 3, F.lit("true")).when(k == 4, F.concat(v, F.lit("0"))).otherwise(F.col("event_type"))
    b = F.when(k == 0, F.concat(v, F.lit("1"))).when(k == 1, F.concat("event_type", F.lit(" "))).when(k == 2, F.when(F.col("event_id") % 4 == 0, F.lit('{"a": [2,3], "b": 1}')).otherwise(F.lit('{"a": [3,2], "b": 1}'))).when(k == 3, F.lit(" TRUE")).when(k == 4, v).otherwise(F.lit("click"))
    return table(s, d, "events").select("event_id", jsons.args_equal(a, b).alias("equal"))


def state_hashes(s, d):
    n = F.col("event_id").cast("string")
    state = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"b": '), n, F.lit(', "a": {"y": null, "x": [1, "é"]}}'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"a":{"x":[1,"é"],"y":null},"b":'), n, F.lit("}")))
    return table(s, d, "events").select("event_id", jsons.state_hash(state).alias("hash"), jsons.state_hash(state, 64).alias("full"), jsons.at_path(state, "a.x").alias("at"), jsons.at_path(state, "b").alias("b"), jsons.at_path(state, "c.d").alias("none"))


def json_fields(s, d):
    k = F.col("event_id") % 4
    t = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("["), "props", F.lit("]"))).when(k == 2, F.lit("{broken"))
    return table(s, d, "events").select("event_id", jsons.json_or(t, "null").alias("value"), jsons.json_object_or_empty(t).alias("extra"))


def _outputs(s, d):
    """Whole turns as model output, with JSON in fences, paragraphs and text, broken or not there."""
    k, j = F.col("turn") % 6, F.concat(F.lit('{"name": "f'), F.col("turn").cast("string"), F.lit('", "arguments": {"x": [1, 2]}}'))
    t = F.translate("text", "{}[]<>", "")
    out = F.when(k == 0, j).when(k == 1, F.concat(t, F.lit("\n```json\n"), j, F.lit("\n```\n"), t)).when(k == 2, F.concat(t, F.lit(" so "), j, F.lit(" done"))).when(k == 3, F.concat(t, F.lit("\n\n"), j)).when(k == 4, F.concat(t, F.lit(" {broken"))).otherwise(t)
    return table(s, d, "conversations").select("conv_id", "turn", out.alias("output"), j.alias("j"), t.alias("t"))


def extract_json(s, d):
    return _outputs(s, d).select("conv_id", "turn", jsons.extract_json(F.col("output")).alias("found"))


def tool_calls(s, d):
    k = F.col("turn") % 4
    tag = lambda c: F.concat(F.lit("<tool_call>"), c, F.lit("</tool_call>"))
    t = F.when(k == 0, F.concat("t", tag(F.col("j")), F.lit("|"), tag(F.col("j")))).when(k == 1, F.concat("t", tag(F.substring_index("j", "}}", 1)))).when(k == 2, F.concat("t", tag(F.lit("not json")))).otherwise(F.col("t"))
    return _outputs(s, d).select("conv_id", "turn", jsons.extract_tool_calls(t).alias("c")).select("conv_id", "turn", F.array_join("c.calls", ";").alias("calls"), F.md5("c.rest").alias("rest"))


def flat_fields(s, d):
    j = F.concat(F.lit('{"a": {"b": '), F.col("event_id").cast("string"), F.lit(', "c": [{"d": 1}, 2]}, "e": "'), F.col("event_type"), F.lit('"}'))
    e = table(s, d, "events").select("event_id", jsons.flattened(j).alias("m"), jsons.field_names(j).alias("names"))
    return e.select("event_id", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda x: F.concat_ws("=", x["key"], x["value"])), ";").alias("flat"), F.array_join("names", ",").alias("names"))


def prompt_messages(s, d):
    k, t = F.col("item_id") % 5, F.to_json(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    p = F.when(k == 0, F.concat(F.lit('[{"role": "system", "content": "be brief"}, '), t, F.lit("]"))).when(k == 1, t).when(k == 2, F.col("text")).when(k == 3, F.lit(" "))
    m = jsons.prompt_messages(p)
    return table(s, d, "benchmark").select("item_id", F.size(m).alias("n"), F.size(jsons.without_system(m)).alias("said"), F.md5(F.array_join(F.transform(m, lambda x: F.concat_ws(":", x["role"], x["content"])), "|")).alias("digest"))


def message_rules(s, d):
    k, t = F.col("turn") % 7, F.translate("text", "<>", "")
    m = F.when(k == 0, t).when(k == 1, F.concat(F.lit("<think>"), t, F.lit("</think>so"))).when(k == 2, F.concat(F.lit("<think> </think>"), t)).when(k == 3, F.concat(t, F.lit("</think>"), t, F.lit("<think>"))).when(k == 4, F.concat(F.lit("<think>a</think><think>b</think>"), t)).when(k == 5, F.lit(" ")).otherwise(F.concat(F.lit("<think>"), t, F.lit("</think>  ")))
    code = F.when(k < 3, F.concat(t, F.lit("<code>\n```python\nx = 1\n```\n</code> after "), F.col("turn").cast("string"))).otherwise(t)
    media = F.concat(F.lit("<image>look "), F.col("turn").cast("string"), F.lit("<video><image> end"))
    return table(s, d, "conversations").select("conv_id", "turn", jsons.think_tags_valid(m).alias("valid"), jsons.code_split(code).alias("c"), jsons.media_segments(media).alias("g")).select(
        "conv_id", "turn", "valid", F.col("c.code").alias("code"), F.md5("c.rest").alias("rest"), F.array_join(F.transform("g", lambda x: F.concat_ws(":", x["type"], x["text"])), "|").alias("media"))


def search_passages(s, d):
    """The passages of the three vectors nearest to each query, formatted in the order of their ranks; whole texts."""
    v = table(s, d, "embeddings")
    hits = retrieval.nearest(v, v.where("vec_id % 20 = 0"), "vec_id", "embedding", 3)
    texts = table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return retrieval.passages(hits, texts, "vec_id", "text").select("query_id", F.md5("passages").alias("passages"))


def _latex():
    i = F.col("item_id").cast("string")
    forms = (F.concat(F.lit("\\frac1"), F.right(i, F.lit(1))), F.concat(F.lit("x = \\dfrac{1}{"), i, F.lit("}")), F.lit("0.5"), F.concat(i, F.lit("/7")), F.concat(F.lit("\\sqrt2 \\text{ cm"), i, F.lit("}")), F.concat(F.lit("\\left( .5, "), i, F.lit("\\%\\right)")), F.concat(F.lit("9"), i, F.lit("^{\\circ}")), F.concat(F.lit("\\frac"), F.right(i, F.lit(1)), F.lit("{72}")))
    return F.element_at(F.array(*forms), (F.col("item_id") % 8 + 1).cast("int"))


def latex_answers(s, d):
    b = table(s, d, "benchmark")
    return b.select("item_id", maths.latex_normal(_latex()).alias("normal"), maths.latex_equal(_latex(), F.when(F.col("item_id") % 8 == 2, "\\frac{1}{2}").when(F.col("item_id") % 8 == 4, "\\sqrt{2}").otherwise("1/7")).alias("equal"))


def score_dispatch(s, d):
    k, i = F.col("item_id") % 8, F.col("item_id").cast("string")
    source = F.element_at(F.array(*map(F.lit, ("openai/gsm8k", "lighteval/MATH", "math_dapo", "aime24", "hiyouga/geometry3k", "searchR1_nq", "tau_bench_retail", "other"))), (k + 1).cast("int"))
    said = F.when(F.col("item_id") % 3 == 0, F.lit("9")).otherwise(i)
    t = F.when(k == 0, F.concat("text", F.lit(" #### "), said)).when(k == 1, F.concat("text", F.lit(" \\boxed{"), said, F.lit("}"))).when(k.isin(2, 3), F.concat("text", F.lit("\nAnswer: "), said)).when(k == 4, F.concat(F.lit("<think>"), "text", F.lit("</think> \\boxed{"), said, F.lit("}"))).when(k == 5, F.concat("text", F.lit("<answer> The "), said, F.lit(".</answer>"))).otherwise(F.col("text"))
    return table(s, d, "benchmark").select("item_id", maths.score_by_source(source, t, i).alias("score"), maths.boxed_equal(t, i).alias("boxed"), maths.tool_box_score(t, i, F.lit(8)).alias("tool"))


def collinear_points(s, d):
    p = F.transform(F.sequence(F.lit(0), (F.col("event_id") % 5).cast("int")), lambda i: F.struct(i.cast("double").alias("x"), F.when(F.col("event_id") % 2 == 0, i * 2.0 + 1).otherwise((i * i).cast("double")).alias("y")))
    return table(s, d, "events").select("event_id", maths.collinear(p).alias("collinear"))


def pair_accuracy(s, d):
    df = samples(s, d).withColumns({"acc": (F.col("length") > 25).cast("double"), "s2": F.sqrt("score")})
    return rounded(policy.pair_accuracy(df, "uid", "pos", "s2", "acc"), "agreement")


def sign_accuracy(s, d):
    df = samples(s, d).withColumns({"acc": (F.col("length") > 25).cast("double"), "s2": F.col("score") - 30000})
    return rounded(policy.sign_accuracy(df, "s2", "acc"), "accuracy")


def correction(s, d):
    df = samples(s, d).withColumn("mask", (F.col("length") > 10).cast("double"))
    out = policy.corrected(df, "mask", "sequence", 2.0, "token", 2.0, veto=0.5)
    return rounded(out.select("uid", "pos", "weight", "kept"), "weight")


def corrected_loss(s, d):
    df = adv.grpo(samples(s, d)).withColumn("mask", (F.col("length") > 10).cast("double"))
    return rounded(policy.LOSSES["corrected"](df, rejection="sequence", upper=3.0), "loss", digits=3)


def entropy_loss(s, d):
    df = samples(s, d).withColumn("mask", (F.col("length") > 10).cast("double"))
    return rounded(policy.entropy_loss(df, F.array("lp", "old_lp", "ref_lp", F.lit(0.0)), "mask"), "loss")


def minibatches(s, d):
    return policy.minibatches(table(s, d, "customer").select("c_custkey"), 64, 2, "c_custkey", 3)


def allocated_tokens(s, d):
    out = policy.allocated_by_length(adv.grpo(samples(s, d)), "advantage", "length")
    return rounded(out.groupBy("uid", "pos").agg(F.count(F.lit(1)).alias("tokens"), F.sum("weight").alias("total")), "total", digits=4)


def aligned_logprobs(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.transform(F.sequence(F.lit(1), (F.col("o_orderkey") % 9 + 1).cast("int")), lambda i: -i / 10.0).alias("lp"))
    return o.select("o_orderkey", F.array_join(F.transform(arrays.aligned_logprobs(F.col("lp"), 5), lambda x: F.round(x, 1)), ",").alias("lp"))


def strict_boxes(s, d):
    k, i = F.col("item_id") % 3, F.col("item_id").cast("string")
    t = F.concat("text", F.lit(" \\boxed{"), F.when(k == 0, i).otherwise(F.lit("7")), F.lit("}"), F.when(k == 2, F.col("text")).otherwise(""))
    return table(s, d, "benchmark").select("item_id", answers.answer_score(t, i, strict_box=True).alias("a"), answers.format_weighted(F.lit(1.0), answers.think_and_box(F.concat(F.when(k > 0, "<think>").otherwise(""), "text", F.lit("</think>"), t))).alias("w")).select("item_id", "a.score", "a.acc", "a.pred", F.round("w", 6).alias("weighted"))


def _folder(s, kind):
    import uuid

    from weftline.session import checkpoint_folder

    return f"{checkpoint_folder(s)}/{kind}-{uuid.uuid4().hex}"


def written_and_read(s, d):
    """Tasks exported as training rows to Parquet and read back, a seeded sample of a fixed number of them."""
    t = _packed(s, d).select(F.col("task").cast("string").alias("task_id"), "domain", F.col("scenario").alias("scenario_type"), F.col("query").alias("user_query"), F.transform("calls", lambda c: F.struct(c["tool_name"].alias("tool_name"), F.to_json(c["arguments"]).alias("arguments"), c["action"].alias("action"))).alias("oracle_calls"), F.array("domain").alias("target_servers"))
    path = _folder(s, "export")
    io.export_rows(t).write.parquet(path)
    rows = io.read_parquet(s, path, columns=["uid", "data_source", "reward_model", "extra_info", "prompt"])
    tools = io.nested(rows, "reward_model", ["ground_truth", "required_tools"])
    return rows.select("uid", "data_source", F.array_join(F.array_sort(tools), ",").alias("tools"), F.col("extra_info.user_query").alias("query"), F.get_json_object("prompt", "$[0].content").alias("prompt"))


def rollouts_round_trip(s, d):
    """Rollouts written as JSON lines by step and read back, with numbers masked."""
    r = table(s, d, "benchmark").select(F.col("text").alias("input"), F.concat("text", F.lit(" 42")).alias("output"), F.lit("g").alias("gts"), (F.col("item_id") / 4).alias("score"), (F.col("item_id") % 3).cast("int").alias("step"))
    path = _folder(s, "rollouts")
    io.write_rollouts(r, path)
    back = io.read_rollouts(s, path, mask=r"\d+")
    return back.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"), F.sum(F.col("output").endswith(" *").cast("long")).alias("masked"))


def shard_merge(s, d):
    """Two overlapping shards of orders merged, first row a key."""
    path = _folder(s, "shards")
    o = table(s, d, "orders").select("o_orderkey", "o_totalprice")
    o.where("o_orderkey % 3 < 2").write.parquet(f"{path}/a")
    o.where("o_orderkey % 3 > 0").write.parquet(f"{path}/b")
    return io.merge_shards(s, f"{path}/*", "o_orderkey", "o_orderkey", 500)


def metric_table(s, d):
    """Metrics appended twice and reduced by step."""
    path = _folder(s, "metrics")
    e = table(s, d, "events").select((F.col("event_id") % 5).alias("step"), F.col("event_type").alias("key"), "value")
    io.append_metrics(e.where("event_id % 2 = 0"), path)
    io.append_metrics(e.where("event_id % 2 = 1"), path)
    return rounded(s.read.parquet(path).groupBy("step", "key").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n")), "value")


def audit_rules(s, d):
    c = tasks.task_checks(_packed(s, d))
    return io.audit(c, {k: F.col(k) for k in c.columns if k != "task"})


QUERIES = {f.__name__: f for f in (
    progress_predicates, target_ids, deleted_target_ids, training_oracle, derived_criteria, protected_fields, task_checks, dataset_checks, hidden_tools, task_scenarios,
    scenario_rules, contract_errors, intents, tool_entities, schema_edges, routed_calls, fuzzy_tools, distractors, minimal_arguments, argument_errors, deletable_customers,
    task_stats, trace_summary, chain_progress, batch_diagnosis, tree_listing, typed_equality, state_hashes, json_fields, extract_json, tool_calls, flat_fields,
    prompt_messages, message_rules, search_passages, latex_answers, score_dispatch, collinear_points, pair_accuracy, sign_accuracy, correction, corrected_loss, entropy_loss,
    minibatches, allocated_tokens, aligned_logprobs, strict_boxes, written_and_read, rollouts_round_trip, shard_merge, metric_table, audit_rules,
)}

_CALLS = f"""{LOG_SQL}, ca AS (SELECT session AS task, step AS i, action_type AS action, CASE WHEN action_type = 'tool_call' THEN tool ELSE action_type END AS tool_name, order_id, note, page, token, ok FROM lg
  WHERE NOT (action_type <> 'tool_call' AND session % 10 = 7)),
tn AS (SELECT task, list(tool_name ORDER BY i) FILTER (action = 'tool_call') AS tools, count(*) AS calls, count(*) FILTER (action <> 'tool_call') AS ends, count(*) FILTER (action = 'tool_call') AS real,
    count(DISTINCT (tool_name, order_id, note, page, token)) FILTER (action = 'tool_call') AS kinds, ['show my orders', 'please create a new order', 'update and delete the note', 'what is the status', 'cancel it'][task % 5 + 1] AS query, task % 10 AS n FROM ca GROUP BY task)"""
_STATES = """o AS (SELECT o_orderkey % 200 AS task, o_orderkey AS k, o_totalprice AS p, o_orderstatus AS s, o_orderpriority AS r FROM orders),
b AS (SELECT * FROM o WHERE k % 5 <> 0), a AS (SELECT task, k, p, CASE WHEN p > 300000 THEN 'X' ELSE s END AS s, CASE WHEN p < 2000 THEN NULL ELSE r END AS r FROM o WHERE k % 7 <> 0),
kn AS (SELECT DISTINCT task FROM b INTERSECT SELECT DISTINCT task FROM a),
cr AS (SELECT task, 'state_exists' AS type, 'orders.' || k AS path, NULL::VARCHAR AS value FROM a WHERE k % 5 = 0 AND task IN (FROM kn) UNION ALL SELECT task, 'state_absent', 'orders.' || k, NULL FROM b WHERE k % 7 = 0 AND task IN (FROM kn)
  UNION ALL SELECT task, 'state_equals', 'orders.' || k || '.status', s FROM a WHERE k % 5 = 0 AND task IN (FROM kn)
  UNION ALL SELECT a.task, 'state_equals', 'orders.' || a.k || '.status', a.s FROM a JOIN b ON a.k = b.k WHERE a.s <> b.s)"""
_READS = "regexp_matches({}, 'list|check|view|get|find|search|look up|lookup|confirm|status|details|schedule|agenda|calendar|history|balance|track|report|summary')"
_J = "'{\"name\": \"f' || turn || '\", \"arguments\": {\"x\": [1, 2]}}'"
_C = "'{\"arguments\":{\"x\":[1,2]},\"name\":\"f' || turn || '\"}'"
_T = "translate(text, '{}[]<>', '')"
_ENT = "list_filter(['event', 'order', 'account', 'email', 'invoice', 'issue', 'lead', 'deal', 'product', 'restaurant', 'channel', 'message', 'file', 'contact', 'payment', 'menu', 'cart', 'transfer', 'transaction'], lambda e: contains({0}, e))[1]"
_CLAMP = "greatest(least({}, 20), -20)"
_GRPO = "CASE WHEN count(*) OVER w = 1 THEN score ELSE score - avg(score) OVER w END / (CASE WHEN count(*) OVER w = 1 THEN 1 ELSE stddev_samp(score) OVER w END + 1e-6)"
ORACLE_SQL = {
    "progress_predicates": f"""WITH {_CALLS}, r AS (SELECT *, (row_number() OVER (PARTITION BY task ORDER BY i) - 1)::INT AS step, CASE WHEN tool_name = 'list_items' THEN 'items' ELSE 'order' END AS entity, tool_name IN ('get_order', 'list_items') AS reads FROM ca WHERE action = 'tool_call'),
      q AS (SELECT *, lag(entity) OVER (PARTITION BY task ORDER BY i) AS prev, row_number() OVER (PARTITION BY task, entity, reads ORDER BY i) AS nth FROM r)
      SELECT task, step, 'resolved_required_entity' AS type, entity, NULL::VARCHAR AS target FROM q WHERE reads AND nth = 1 UNION ALL SELECT task, step, 'completed_required_transition', entity, coalesce(order_id, '') FROM q WHERE NOT reads
      UNION ALL SELECT task, step, 'satisfied_dependency_edge', entity, NULL FROM q WHERE entity = prev
      UNION ALL SELECT task, real::INT, unnest(['verified_postcondition', 'produced_required_response']), NULL, NULL FROM tn WHERE ends > 0 AND real > 0""",
    "target_ids": f"WITH {_CALLS} SELECT DISTINCT task, order_id AS id FROM ca WHERE order_id IS NOT NULL",
    "deleted_target_ids": f"WITH {_CALLS} SELECT DISTINCT task, order_id AS id FROM ca WHERE tool_name = 'delete_order'",
    "training_oracle": f"WITH {_CALLS} SELECT ca.task, ca.i, ca.tool_name, CASE WHEN ends = 0 THEN 'no_terminal' END AS error FROM ca JOIN tn USING (task) QUALIFY ends > 0 OR row_number() OVER (PARTITION BY ca.task ORDER BY ca.i) = 1",
    "derived_criteria": f"WITH {_STATES} SELECT * FROM cr",
    "protected_fields": f"""WITH {_STATES}, t AS (SELECT task, k FROM b WHERE k % 3 = 0), f AS (SELECT task, k, unnest(['status', 'priority']) AS field FROM t)
      SELECT f.task, f.k::VARCHAR AS entity, f.field FROM f WHERE NOT EXISTS (SELECT 1 FROM cr WHERE cr.task = f.task AND cr.path = 'orders.' || f.k || '.' || f.field)""",
    "task_checks": f"""WITH {_CALLS} SELECT task, true AS chain_length, n <> 0 AS abstains, true AS named, kinds = real AS distinct_calls, CASE WHEN n = 1 THEN false ELSE (n = 0) = (n < 2) END AS missing_flag,
      NOT (n = 0 AND query IN ('show my orders', 'what is the status')) AS semantic, task % 7 BETWEEN 1 AND 5 AS rounds FROM tn""",
    "dataset_checks": f"WITH {_CALLS} SELECT count(DISTINCT CASE WHEN n = 0 THEN 1 ELSE 2 END) FILTER (task % 3 = 0) = 2 AS scenarios, bool_or(task % 3 = 0 AND task % 7 = 1) AS single_round, true AS domain_cover, count(DISTINCT n < 4) AS domains FROM tn",
    "hidden_tools": f"""WITH {_CALLS}, h AS (SELECT *, CASE WHEN tools[-1] IN ('get_order', 'update_order') THEN tools[-1] ELSE 'update_order' END AS tool FROM tn),
      m AS (SELECT *, coalesce(list_contains(tools, tool), false) AND (tool = 'get_order' OR regexp_matches(query, 'update|edit|change|modify|set|mark|move|reschedule|rename|assign|complete|transition|log')) AS hide FROM h)
      SELECT task, CASE WHEN hide THEN tool END AS hidden, CASE WHEN hide THEN 'no_tool_or_abstention' ELSE 'normal_safe_success' END AS scenario, (CASE WHEN hide THEN 1 ELSE calls END)::INT AS n FROM m""",
    "task_scenarios": """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'tool_error_recovery' WHEN o_orderkey % 4 < 2 THEN 'no_tool_or_abstention' ELSE 'normal_safe_success' END AS scenario,
      ['preserve', 'append_only', 'create_new', 'domain_defined', 'domain_defined'][o_orderkey % 5 + 1] AS policy FROM orders""",
    "scenario_rules": f"""WITH {_CALLS}, s AS (SELECT task, CASE WHEN task % 12 = 0 THEN [] ELSE coalesce(tools, []) END AS t FROM tn),
      g AS (SELECT task, t, list_position(t, 'delete_order') AS d, len(t) - coalesce(nullif(list_position(list_reverse(t), 'create_order'), 0), len(t) + 1) + 1 AS c, list_min(list_transform(list_filter(list_transform(t, lambda x, i: {{'x': x, 'i': i}}), lambda z: z.x IN ('update_order', 'delete_order')), lambda z: z.i)) AS ch,
        list_min(list_transform(list_filter(list_transform(t, lambda x, i: {{'x': x, 'i': i}}), lambda z: z.x IN ('get_order', 'create_order')), lambda z: z.i)) AS src FROM s)
      SELECT task, CASE WHEN task % 6 = 0 AND len(t) = 0 THEN 'clarification_required' WHEN task % 11 = 0 THEN 'tool_error_recovery' WHEN len(t) = 0 THEN 'normal_safe_success' WHEN coalesce(d, 0) > 0 AND c > d THEN 'unsafe_temptation'
        WHEN ch IS NOT NULL AND coalesce(ch < src, true) THEN 'missing_dependency' ELSE 'normal_safe_success' END AS scenario FROM g""",
    "contract_errors": f"""WITH {_CALLS} SELECT task, CASE WHEN ends <> 1 THEN 'terminal_count' WHEN n = 0 AND real > 0 THEN 'unexpected_call' WHEN n <> 0 AND real NOT BETWEEN 2 AND 5 THEN 'call_count' WHEN task % 9 = 0 THEN 'stale_year' END AS error FROM tn""",
    "intents": f"""WITH t AS (SELECT conv_id, turn, lower(text || CASE conv_id % 5 WHEN 0 THEN ' Please show the agenda' WHEN 1 THEN ' please re-send it' WHEN 2 THEN ' run export data now' ELSE '' END) AS x, conv_id % 5 AS k FROM conversations),
      w AS (SELECT *, CASE k WHEN 1 THEN regexp_matches(x, 'send|reply|forward|pay|refund|transfer|wire|checkout|return|reorder|deposit|withdraw|freeze|convert') WHEN 2 THEN contains(x, 'export') AND contains(x, 'data')
        WHEN 3 THEN regexp_matches(x, 'delete|remove|cancel|archive|clear|drop') ELSE regexp_matches(x, 'create|make|new|book|draft|register|open') END AS writes FROM t)
      SELECT conv_id, turn, {_READS.format('x')} AS reads, writes, turn % 2 = 0 AND (k >= 3 OR writes) AS needed FROM w""",
    "tool_entities": f"""WITH t AS (SELECT event_id, ['get_order', 'send_email', 'list_issues', 'mkdir', 'add_reaction'][event_id % 5 + 1] || CASE WHEN event_id % 2 = 0 THEN '' ELSE '_' || event_type END AS t FROM events)
      SELECT event_id, coalesce({_ENT.format('t')}, string_split(t, '_')[-1]) AS entity FROM t""",
    "schema_edges": f"""WITH s AS (SELECT n_nationkey AS n, ['get_order_', 'send_email_', 'x_item_'][n_nationkey % 3 + 1] || n_nationkey AS tool, 'id' || n_nationkey % 7 AS o1, 'id' || (n_nationkey + 1) % 11 AS r FROM nation),
      k AS (SELECT tool, coalesce({_ENT.format('tool')}, string_split(tool, '_')[-1]) AS e FROM s), e AS (SELECT DISTINCT a.tool AS src, b.tool AS dst FROM s a JOIN s b ON a.o1 = b.r AND a.tool <> b.tool)
      SELECT src, dst, 'explicit' AS relation FROM e UNION ALL SELECT a.tool, b.tool, 'implicit' FROM k a JOIN k b ON a.e = b.e AND a.tool <> b.tool WHERE a.tool NOT IN (SELECT src FROM e)""",
    "routed_calls": """WITH s AS (SELECT 't' || n_nationkey % 9 AS tool, 's' || n_regionkey AS server, 'id' || (n_nationkey + 1) % 11 AS r, n_nationkey AS nth FROM nation),
      c AS (SELECT o_orderkey AS id, 't' || o_orderkey % 11 AS tool, CASE WHEN o_orderkey % 2 = 0 THEN 's' || o_orderkey % 5 END AS domain, 'id' || o_custkey % 12 AS k FROM orders)
      SELECT c.id, c.tool, s.server FROM c LEFT JOIN s USING (tool) QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY CASE WHEN server = domain THEN 0 WHEN r = k THEN 1 ELSE 2 END, nth) = 1""",
    "distractors": """WITH r AS (SELECT list_sort(list(DISTINCT t)) AS a FROM (SELECT p_type AS t FROM part UNION SELECT c_mktsegment FROM customer)), c AS (SELECT 't' || c_custkey AS task, c_mktsegment AS k FROM customer),
      d AS (SELECT task, list_sort(list_transform(list_filter(a, lambda x: x <> k), lambda x: {'h': md5(task || ':' || x), 't': x}))[1:(3 + ('0x' || substr(md5(task), 1, 8))::BIGINT % 6)] AS d FROM c, r) SELECT task, unnest(d).t AS tool FROM d""",
    "minimal_arguments": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE ['', '0', '0', 'false', '[]', '{}', ''][p_partkey % 7 + 1] END AS value FROM part",
    "argument_errors": """SELECT event_id, ['', 'n', 'id', 'n'][event_id % 4 + 1] AS missing, ['', '', 'zz', ''][event_id % 4 + 1] AS unexpected, ['', 'id', 'n', ''][event_id % 4 + 1] AS type_errors, ['', 'kind', '', ''][event_id % 4 + 1] AS enum_errors FROM events""",
    "deletable_customers": "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) THEN 'referenced' END AS error FROM customer",
    "task_stats": f"""WITH {LOG_SQL}, t AS (SELECT DISTINCT session, CASE WHEN session % 3 = 0 THEN 'orders' ELSE 'items' END AS domain, CASE WHEN session % 10 = 0 THEN 'idle' ELSE 'busy' END AS scenario FROM lg)
      SELECT coalesce(domain, 'all') AS domain, coalesce(scenario, 'all') AS scenario, count(*) AS n, sum((session % 4 = 0)::INT)::BIGINT AS empty_criteria FROM t GROUP BY CUBE (domain, scenario)""",
    "trace_summary": f"WITH {LOG_SQL}, b AS (SELECT session, count(*) AS c, sum((NOT ok)::INT) AS e FROM lg GROUP BY session) SELECT count(*) AS sessions, sum(c)::BIGINT AS calls, sum(e)::BIGINT AS errors, sum((e > 0)::INT)::BIGINT AS failed_sessions, (SELECT count(DISTINCT tool) FROM lg) AS tools FROM b",
    "chain_progress": f"""WITH {_CALLS}, p AS (SELECT tn.task, coalesce(min(i) FILTER (tool_name = 'get_order'), 99) AS a FROM tn JOIN ca USING (task) GROUP BY tn.task), q AS (SELECT p.task, a, coalesce(min(i) FILTER (tool_name = 'list_items' AND i > a), 99) AS b FROM p JOIN ca USING (task) GROUP BY p.task, a),
      r AS (SELECT q.task, a, b, coalesce(min(i) FILTER (tool_name = 'get_order' AND i > b), 99) AS c FROM q JOIN ca USING (task) GROUP BY q.task, a, b) SELECT task, (a < 99)::INT + (b < 99)::INT + (c < 99)::INT AS met FROM r""",
    "batch_diagnosis": "WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey), s AS (SELECT n, count(*) AS g FROM g GROUP BY n), m AS (SELECT n AS modal FROM s ORDER BY g DESC, n LIMIT 1) SELECT modal, sum(g)::BIGINT AS groups, sum(CASE WHEN n <> modal THEN g ELSE 0 END)::BIGINT AS incomplete FROM s, m GROUP BY modal",
    "tree_listing": "SELECT lang AS folder, 1 AS depth, count(*) AS files FROM documents GROUP BY lang UNION ALL SELECT lang || '/' || source, 2, count(*) FROM documents GROUP BY lang, source",
    "typed_equality": """SELECT event_id, CASE event_id % 6 WHEN 0 THEN (round(value, 2)::VARCHAR || '1')::DOUBLE - round(value, 2) < 1e-9 WHEN 1 THEN true WHEN 2 THEN event_id % 4 = 0 WHEN 3 THEN true WHEN 4 THEN true ELSE event_type = 'click' END AS equal FROM events""",
    "state_hashes": """WITH t AS (SELECT event_id, CASE WHEN event_id % 3 < 2 THEN '{"a": {"x": [1, "\\u00e9"], "y": null}, "b": ' || event_id || '}' END AS s FROM events)
      SELECT event_id, coalesce(left(sha256(s), 16), '') AS hash, coalesce(sha256(s), '') AS "full", CASE WHEN s IS NOT NULL THEN '[1,"é"]' END AS at, CASE WHEN s IS NOT NULL THEN event_id::VARCHAR END AS b, NULL::VARCHAR AS none FROM t""",
    "json_fields": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '[' || props || ']' ELSE 'null' END AS value, CASE event_id % 4 WHEN 0 THEN props ELSE '{}' END AS extra FROM events",
    "extract_json": f"SELECT conv_id, turn, CASE WHEN turn % 6 < 4 THEN {_C} END AS found FROM conversations",
    "tool_calls": f"SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN {_C} || ';' || {_C} WHEN 1 THEN {_C} ELSE '' END AS calls, md5(CASE turn % 4 WHEN 0 THEN {_T} || '|' ELSE {_T} END) AS rest FROM conversations",
    "flat_fields": """SELECT event_id, 'a.b=' || event_id || ';a.c=[{"d":1},2];e=' || event_type AS flat, 'a,a.b,a.c,a.c.d,b,c,d,e' AS names FROM events""",
    "message_rules": r"""WITH t AS (SELECT conv_id, turn, turn % 7 AS k, translate(text, '<>', '') AS t FROM conversations)
      SELECT conv_id, turn, CASE k WHEN 0 THEN trim(t, ' ') <> '' WHEN 1 THEN trim(t, ' ') <> '' ELSE false END AS valid, CASE WHEN k < 3 THEN 'x = 1' END AS code, md5(CASE WHEN k < 3 THEN ' after ' || turn ELSE t END) AS rest, 'image:|text:look ' || turn || '|video:|image:|text: end' AS media FROM t""".replace("'image:|", "'image|").replace("'|video:|image:|", "'|video|image|"),
    "latex_answers": r"""WITH f AS (SELECT item_id, ['\frac{1}{' || right(item_id::VARCHAR, 1) || '}', '\frac{1}{' || item_id || '}', '\frac{1}{2}', '\frac{' || item_id || '}{7}', '\sqrt{2}', '(0.5,' || item_id || ')', '9' || item_id, '\frac{' || right(item_id::VARCHAR, 1) || '}{72}'][item_id % 8 + 1] AS normal FROM benchmark)
      SELECT item_id, normal, normal = CASE item_id % 8 WHEN 2 THEN '\frac{1}{2}' WHEN 4 THEN '\sqrt{2}' ELSE '\frac{1}{7}' END AS equal FROM f""",
    "score_dispatch": r"""WITH b AS (SELECT item_id, item_id % 8 AS k, item_id % 3 <> 0 OR item_id = 9 AS r FROM benchmark)
      SELECT item_id, CASE k WHEN 0 THEN r::INT WHEN 1 THEN r::INT WHEN 2 THEN CASE WHEN r THEN 1 ELSE -1 END WHEN 3 THEN CASE WHEN r THEN 1 ELSE -1 END WHEN 4 THEN 0.9::DOUBLE * r::INT + 0.1::DOUBLE WHEN 5 THEN r::INT WHEN 6 THEN 0 END::DOUBLE AS score,
        (k IN (1, 4) AND r)::INT::DOUBLE AS boxed, CASE WHEN k IN (1, 4) AND r THEN 1.0 ELSE -0.7 END::DOUBLE AS tool FROM b""",
    "collinear_points": "SELECT event_id, event_id % 5 >= 2 AND event_id % 2 = 0 AS collinear FROM events",
    "pair_accuracy": f"""WITH {SAMPLES_SQL}, x AS (SELECT uid, pos, sqrt(score) AS s, (length > 25)::INT AS a FROM s), p AS (SELECT x.uid, abs(x.a - y.a) AS w, (x.s > y.s) = (x.a > y.a) AS g FROM x JOIN x y ON x.uid = y.uid AND x.pos < y.pos)
      SELECT u.uid, round(CASE WHEN coalesce(sum(w), 0) = 0 THEN 0.5 ELSE sum(w * g::INT) / sum(w) END, 6) + 0.0 AS agreement FROM (SELECT DISTINCT uid FROM s) u LEFT JOIN p ON p.uid = u.uid GROUP BY u.uid""",
    "sign_accuracy": f"WITH {SAMPLES_SQL} SELECT round(avg((sign(score - 30000) = CASE WHEN length > 25 THEN 1 ELSE -1 END)::INT), 6) + 0.0 AS accuracy FROM s",
    "correction": f"""WITH {SAMPLES_SQL}, t AS (SELECT *, (length > 10)::INT AS m, {_CLAMP.format('sum(lp - old_lp) OVER (PARTITION BY uid)')} AS d, 1 - max((lp - old_lp < ln(0.5::DOUBLE))::INT) OVER (PARTITION BY uid) AS v FROM s)
      SELECT uid, pos, round(least(exp(d), 2) * m, 6) + 0.0 AS weight, (m * v * (exp({_CLAMP.format('lp - old_lp')}) BETWEEN 0.5 AND 2)::INT)::DOUBLE AS kept FROM t""",
    "corrected_loss": f"""WITH {SAMPLES_SQL}, a AS (SELECT *, {_GRPO} AS adv, (length > 10)::INT AS m, {_CLAMP.format('lp - old_lp')} AS d, exp({_CLAMP.format('sum(lp - old_lp) OVER w')}) AS r FROM s WINDOW w AS (PARTITION BY uid)),
      l AS (SELECT uid, -adv * lp * least(exp(d), 2) * m AS l, m * (r BETWEEN 1 / 3::DOUBLE AND 3)::INT AS k FROM a), q AS (SELECT sum(l * k) AS t FROM l GROUP BY uid HAVING sum(k) > 0) SELECT round(avg(t), 3) + 0.0 AS loss FROM q""",
    "entropy_loss": f"""WITH {SAMPLES_SQL}, x AS (SELECT (length > 10)::INT AS m, lp AS a, old_lp AS b, ref_lp AS c FROM s), z AS (SELECT *, exp(a) + exp(b) + exp(c) + 1 AS z FROM x)
      SELECT round(sum((ln(z) - (a * exp(a) + b * exp(b) + c * exp(c)) / z) * m) / sum(m), 6) + 0.0 AS loss FROM z""",
    "minibatches": """WITH e AS (SELECT c_custkey, k AS epoch, (SELECT count(*) FROM customer) AS n, row_number() OVER (PARTITION BY k ORDER BY md5('3:' || k || ':' || c_custkey), c_custkey) - 1 AS i FROM customer, range(2) r(k))
      SELECT c_custkey, epoch::INT AS epoch, (i // 64)::INT AS batch FROM e WHERE i < n - n % 64""",
    "aligned_logprobs": "SELECT o_orderkey, array_to_string(list_transform(range(1, 6), lambda i: CASE WHEN i <= o_orderkey % 9 + 1 THEN '-' || (i // 10) || '.' || (i % 10) ELSE '-1.0' END), ',') AS lp FROM orders",
    "strict_boxes": r"""WITH b AS (SELECT item_id, item_id % 3 AS k, text FROM benchmark), p AS (SELECT *, CASE WHEN k = 2 AND length(text) + length('\boxed{7}') > 100 THEN NULL WHEN k = 0 THEN item_id::VARCHAR ELSE '7' END AS pred FROM b)
      SELECT item_id, CASE WHEN pred = item_id::VARCHAR THEN 1.0 ELSE -1.0 END::DOUBLE AS score, coalesce(pred = item_id::VARCHAR, false) AS acc, pred, CASE WHEN k > 0 THEN 1.0 ELSE 0.9 END::DOUBLE AS weighted FROM p""",
    "written_and_read": f"WITH {_CALLS} SELECT task::VARCHAR AS uid, CASE WHEN n < 4 THEN 'orders' ELSE 'items' END AS data_source, array_to_string(list_sort(list_distinct(coalesce(tools, []))), ',') AS tools, query, query AS prompt FROM tn",
    "rollouts_round_trip": "SELECT (item_id % 3)::INT AS step, count(*) AS n, sum(item_id / 4) AS score, count(*) AS masked FROM benchmark GROUP BY 1",
    "shard_merge": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500",
    "search_passages": r"""WITH c AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS cos FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
      h AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, vec_id) AS rank FROM c QUALIFY rank <= 3),
      r AS (SELECT query_id, text, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM h JOIN documents ON doc_id = vec_id WHERE text IS NOT NULL),
      p AS (SELECT query_id, string_agg('Doc ' || i || ' (Title: ' || string_split(text, chr(10))[1] || ')' || chr(10) || array_to_string(string_split(text, chr(10))[2:], chr(10)) || chr(10) || chr(10), '' ORDER BY i) AS t FROM r GROUP BY query_id)
      SELECT query_id, md5(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS passages FROM p""",
    "prompt_messages": """WITH b AS (SELECT item_id, item_id % 5 AS k, text FROM benchmark)
      SELECT item_id, [2, 1, 1, 0, 0][k + 1]::INT AS n, [1, 1, 1, 0, 0][k + 1]::INT AS said, md5(CASE WHEN k = 0 THEN 'system:be brief|user:' || text WHEN k < 3 THEN 'user:' || text ELSE '' END) AS digest FROM b""",
    "allocated_tokens": f"""WITH {SAMPLES_SQL}, a AS (SELECT uid, pos, length, {_GRPO} AS adv FROM s WINDOW w AS (PARTITION BY uid)) SELECT uid, pos, length::BIGINT AS tokens, round(adv / sqrt(length) * length, 4) + 0.0 AS total FROM a WHERE length > 0""",
    "metric_table": "SELECT event_id % 5 AS step, event_type AS key, round(avg(value), 6) + 0.0 AS value, count(*) AS n FROM events GROUP BY 1, 2",
}
_CHECKS = ("chain_length", "abstains", "named", "distinct_calls", "missing_flag", "semantic", "rounds")
ORACLE_SQL["audit_rules"] = f"""WITH t AS ({ORACLE_SQL['task_checks']}), f AS (SELECT unnest([{', '.join(f"'{c}'" for c in _CHECKS)}]) AS "check", unnest([{', '.join(f'sum((NOT {c})::INT)' for c in _CHECKS)}])::BIGINT AS failures FROM t)
  SELECT "check", failures = 0 AS passed, failures FROM f"""
