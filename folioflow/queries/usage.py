"""Queries of usage, cost, quotas, conversations, stars and catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import upsert, usage
from ..sources.tables import CALLS_SQL, calls, read
from . import register

PRICE_SQL = "(values " + ", ".join(f"('{m}', {a}::double, {b}::double, {c}::double)" for m, (a, b, c) in usage.PRICES.items()) + ") as prices(model, p_in, p_cached, p_out)"
COST_SQL = f"""costs as (select c.*, round(coalesce(((input_tokens - greatest(0, least(cached_tokens, input_tokens))) * p_in + greatest(0, least(cached_tokens, input_tokens)) * p_cached
  + (output_tokens + thinking_tokens) * p_out) / 1e6, 0), 8) as cost_usd from {CALLS_SQL} c left join {PRICE_SQL} using (model))"""
#: "Today" of queries on events: the day of the last one.
DAY_SQL = "(select max(ts)::date from events)"
PLAN_SQL = "(values " + ", ".join(f"('{p}', {a}, {b}, {c}, {d})" for p, (a, b, c, d) in usage.PLANS.items()) + ") as plans(plan, searches, downloads, starred, history_days)"
USER_PLAN_SQL = "case user_id % 4 when 0 then 'starter' when 1 then 'pro' when 2 then 'enterprise' else 'gone' end"
ACTION_SQL = "case event_type when 'view' then 'search' when 'click' then 'pdf_download' else event_type end"


def last_day(spark, sf_dir) -> Column:
    """Day of the last event, as a subquery of the plan that uses it."""
    return read(spark, sf_dir, "events").agg(F.to_date(F.max("ts"))).scalar()


def since(spark, sf_dir, days: int) -> Column:
    """Whether an event lies in the last ``days`` days; compares its time itself, so that the scan can skip the rest."""
    return F.col("ts") >= F.date_sub(last_day(spark, sf_dir), days - 1).cast("timestamp")


def actions(spark, sf_dir) -> DataFrame:
    """Events as counted actions."""
    action = F.when(F.col("event_type") == "view", "search").when(F.col("event_type") == "click", "pdf_download").otherwise(F.col("event_type"))
    return read(spark, sf_dir, "events").select("user_id", "ts", action.alias("action"), F.lit(1).cast("long").alias("amount"))


def users(spark, sf_dir) -> DataFrame:
    u = read(spark, sf_dir, "events").select("user_id").distinct()
    plan = F.when(F.col("user_id") % 4 == 0, "starter").when(F.col("user_id") % 4 == 1, "pro").when(F.col("user_id") % 4 == 2, "enterprise").otherwise("gone")
    return u.withColumn("plan", plan)


@register("llm_cost", f"with {COST_SQL} select event_id, model, cost_usd from costs")
def llm_cost(spark, sf_dir):
    return usage.cost(calls(spark, sf_dir)).select("event_id", "model", "cost_usd")


@register("llm_cache_cost", f"select event_id, round(case when input_tokens * 4.5 * 0.25 / 1e6 > 0 then input_tokens * 4.5 * 0.25 / 1e6 else 0 end, 9) as cache_usd from {CALLS_SQL}")
def llm_cache_cost(spark, sf_dir):
    return calls(spark, sf_dir).select("event_id", F.round(usage.cache_cost(F.col("input_tokens"), 4.5, 0.25), 9).alias("cache_usd"))


@register(
    "llm_user_totals",
    f"""with {COST_SQL}, everyone as (select distinct user_id from events union select c_custkey from customer)
    select user_id, count(event_id) as calls, coalesce(sum(input_tokens), 0)::bigint as input_tokens, coalesce(sum(output_tokens), 0)::bigint as output_tokens,
    coalesce(sum(thinking_tokens), 0)::bigint as thinking_tokens, round(coalesce(sum(cost_usd), 0), 6) as cost_usd from everyone left join costs using (user_id) group by user_id""",
)
def llm_user_totals(spark, sf_dir):
    """Users without calls get zeros: customer keys stand for registered users."""
    everyone = read(spark, sf_dir, "events").select("user_id").union(read(spark, sf_dir, "customer").select("c_custkey"))
    return usage.totals(usage.cost(calls(spark, sf_dir)), everyone)


@register(
    "llm_daily_totals",
    f"""with {COST_SQL} select strftime(timestamp, '%Y-%m-%d') as day, count(*) as calls, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, round(sum(cost_usd), 6) as cost_usd
    from costs where timestamp >= {DAY_SQL} - 7 group by day order by day limit 8""",
)
def llm_daily_totals(spark, sf_dir):
    c = usage.cost(calls(spark, sf_dir))
    start = F.date_sub(last_day(spark, sf_dir), 7)
    day = F.date_format("timestamp", "yyyy-MM-dd").alias("day")
    own = c.where(F.col("timestamp") >= start).groupBy(day).agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))
    return own.orderBy("day").limit(8)


@register(
    "llm_model_breakdown",
    f"""with {COST_SQL} select model, count(*) as calls, round(sum(cost_usd), 6) as cost_usd, sum(input_tokens + output_tokens + thinking_tokens)::bigint as tokens
    from costs where timestamp >= {DAY_SQL} - 30 group by model order by cost_usd desc, model limit 20""",
)
def llm_model_breakdown(spark, sf_dir):
    c = usage.cost(calls(spark, sf_dir))
    start = F.date_sub(last_day(spark, sf_dir), 30)
    tokens = F.sum(F.col("input_tokens") + F.col("output_tokens") + F.col("thinking_tokens")).alias("tokens")
    own = c.where(F.col("timestamp") >= start).groupBy("model").agg(F.count("*").alias("calls"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"), tokens)
    return own.orderBy(F.desc("cost_usd"), "model").limit(20)


@register("llm_call_record", f"with {COST_SQL} select event_id, round(cost_usd, 8) as cost_usd, round(input_tokens / 1000.0, 3) as seconds, left(event_id::varchar || ' ' || model, 200) as preview from costs")
def llm_call_record(spark, sf_dir):
    c = usage.cost(calls(spark, sf_dir))
    return c.select("event_id", F.round("cost_usd", 8).alias("cost_usd"), F.round(F.col("input_tokens") / 1000.0, 3).alias("seconds"), F.substring(F.concat_ws(" ", F.col("event_id").cast("string"), "model"), 1, 200).alias("preview"))


@register("usage_daily_counters", f"select user_id, strftime(ts, '%Y-%m-%d') as date, {ACTION_SQL} as action, count(*) as amount from events group by all")
def usage_daily_counters(spark, sf_dir):
    return usage.daily_counters(actions(spark, sf_dir))


@register(
    "usage_today_pivot",
    f"""select user_id, count(*) filter (event_type = 'view') as search, count(*) filter (event_type = 'click') as pdf_download from events where ts::date = {DAY_SQL} group by user_id""",
)
def usage_today_pivot(spark, sf_dir):
    own = usage.daily_counters(actions(spark, sf_dir).where(since(spark, sf_dir, 1)))
    return own.groupBy("user_id").pivot("action", ["search", "pdf_download"]).agg(F.sum("amount")).fillna(0)


@register(
    "usage_last_n_days",
    f"""with days as (select unnest(generate_series({DAY_SQL} - interval 6 day, {DAY_SQL}::timestamp, interval 1 day))::date as day), u as (select distinct user_id from events)
    select user_id, strftime(day, '%Y-%m-%d') as date, (select count(*) from events e where e.user_id = u.user_id and e.ts::date = day) as amount,
    sum((select count(*) from events e where e.user_id = u.user_id and e.ts::date = day)) over (partition by user_id)::bigint as total from u, days""",
)
def usage_last_n_days(spark, sf_dir):
    series = usage.last_days(usage.daily_counters(actions(spark, sf_dir).where(since(spark, sf_dir, 7))), users(spark, sf_dir), last_day(spark, sf_dir), 7)
    return series.withColumn("total", F.sum("amount").over(Window.partitionBy("user_id")))


@register(
    "quota_check",
    f"""with u as (select distinct user_id, {USER_PLAN_SQL} as plan from events), used as (select user_id, count(*) filter (event_type = 'view') as used from events where ts::date = {DAY_SQL} group by user_id)
    select u.user_id, coalesce(p.plan, 'starter') as plan, coalesce(used, 0) as used, coalesce(p.searches, 10) < 0 or coalesce(used, 0) < coalesce(p.searches, 10) as allowed,
    case when coalesce(p.searches, 10) < 0 then -1 else greatest(0, coalesce(p.searches, 10) - coalesce(used, 0)) end as remaining
    from u left join {PLAN_SQL} as p on u.plan = p.plan left join used using (user_id)""".replace(") as plans(plan, searches, downloads, starred, history_days) as p", ") as p(plan, searches, downloads, starred, history_days)"),
)
def quota_check(spark, sf_dir):
    used = usage.daily_counters(actions(spark, sf_dir).where(since(spark, sf_dir, 1) & (F.col("action") == "search"))).select("user_id", F.col("amount").alias("used"))
    j = usage.with_plan(users(spark, sf_dir)).join(used, "user_id", "left").fillna(0, ["used"])
    allowed, remaining = usage.quota(F.col("used"), F.col("searches"))
    plan = F.when(F.col("plan").isin(*usage.PLANS), F.col("plan")).otherwise(usage.DEFAULT_PLAN)
    return j.select("user_id", plan.alias("plan"), "used", allowed.alias("allowed"), remaining.cast("int").alias("remaining"))


@register("documents_page", "select doc_id, category, created_at from documents where category = 'notices' order by created_at desc, doc_id offset 10 limit 20")
def documents_page(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("category = 'notices'").select("doc_id", "category", "created_at")
    return d.orderBy(F.desc("created_at"), "doc_id").offset(10).limit(20)


@register(
    "studio_catalog",
    """select doc_id::varchar as document_id, coalesce(nullif(left(text, 40), ''), doc_id::varchar) as title, category, coalesce(nullif(source, ''), '') as summary from documents
    where doc_id % 5 <> 0 and category in ('notices', 'gazette', 'finance_acts', 'case_notes', 'acts_rules', 'directives')""",
)
def studio_catalog(spark, sf_dir):
    """Completed documents (four fifths) of the six categories."""
    d = read(spark, sf_dir, "documents").where("doc_id % 5 <> 0").where(F.col("category").isin("notices", "gazette", "finance_acts", "case_notes", "acts_rules", "directives"))
    key = F.col("doc_id").cast("string")
    title = F.coalesce(F.nullif(F.substring("text", 1, 40), F.lit("")), key)
    return d.select(key.alias("document_id"), title.alias("title"), "category", F.coalesce(F.nullif("source", F.lit("")), F.lit("")).alias("summary"))


@register(
    "documents_upsert",
    """with old as (select doc_id, category, created_at from documents where doc_id % 3 <> 0), new as (select doc_id, upper(category) as category, created_at + interval 1 day as created_at from documents where doc_id % 2 = 0)
    select coalesce(o.doc_id, n.doc_id) as doc_id, case when n.doc_id is not null then n.category else o.category end as category, coalesce(o.created_at, n.created_at) as created_at from old o full outer join new n on o.doc_id = n.doc_id""",
)
def documents_upsert(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "category", "created_at")
    new = d.where("doc_id % 2 = 0").select("doc_id", F.upper("category").alias("category"), (F.col("created_at") + F.expr("interval 1 day")).alias("created_at"))
    return upsert.merge(d.where("doc_id % 3 <> 0"), new, ["doc_id"], ["created_at"])


@register(
    "delete_cascade",
    """select 'word_bboxes' as kept, count(*) as n from word_bboxes where document_id not in (select document_id from parsed_documents where ocr_used) union all
    select 'parse_requests', count(*) from parse_requests where document_id not in (select document_id from parsed_documents where ocr_used) union all
    select 'ocr_words', count(*) from ocr_words where document_id not in (select document_id from parsed_documents where ocr_used)""",
)
def delete_cascade(spark, sf_dir):
    """What stays of each table when the scanned documents are deleted with all that belongs to them."""
    gone = read(spark, sf_dir, "parsed_documents").where("ocr_used").select("document_id")
    out = None
    for t in ("word_bboxes", "parse_requests", "ocr_words"):
        part = read(spark, sf_dir, t).join(gone, "document_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit(t).alias("kept"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "chat_sidebar",
    """select user_id, result_id, created_at from (select user_id, result_id, created_at, row_number() over (partition by user_id order by created_at desc, result_id desc) as n,
    max(created_at) over () as now from query_results where user_id is not null) where n <= 15 and created_at >= now - interval 200 day""",
)
def chat_sidebar(spark, sf_dir):
    """The 15 latest searches of each user within the days that are kept."""
    q = read(spark, sf_dir, "query_results").where("user_id is not null").select("user_id", "result_id", "created_at")
    now = q.agg(F.max("created_at").alias("now"))
    recent = q.join(F.broadcast(now), F.lit(True)).where(F.col("created_at") >= F.col("now") - F.expr("interval 200 days")).drop("now")
    return upsert.newest(recent, ["user_id"], [F.desc("created_at"), F.desc("result_id")], 15)


@register(
    "chat_record_turn",
    r"""select user_id, workspace_id, arg_max(case when length(t) <= 56 then t else left(t, 53) || '…' end, (starred_at, id)) as title, max(starred_at) as last_activity_at
    from (select *, trim(regexp_replace(query, '\s+', ' ', 'g')) as t from (select distinct on (id) * from starred_responses)) group by user_id, workspace_id""",
)
def chat_record_turn(spark, sf_dir):
    s = read(spark, sf_dir, "starred_responses").dropDuplicates(["id"])
    title = F.max_by(T.short_title(F.col("query")), F.struct("starred_at", "id")).alias("title")
    return s.groupBy("user_id", "workspace_id").agg(title, F.max("starred_at").alias("last_activity_at"))


@register(
    "chat_prune",
    """with kept as (select user_id, workspace_id from (select user_id, workspace_id, row_number() over (partition by user_id order by max(starred_at) desc, workspace_id) as n from starred_responses group by user_id, workspace_id) where n <= 2)
    select distinct s.id, s.user_id, s.workspace_id from starred_responses s join kept using (user_id, workspace_id)""",
)
def chat_prune(spark, sf_dir):
    """Answers of the two latest workspaces of each user; those of pruned ones go with them."""
    s = read(spark, sf_dir, "starred_responses").select("id", "user_id", "workspace_id", "starred_at")
    spaces = s.groupBy("user_id", "workspace_id").agg(F.max("starred_at").alias("at"))
    kept = upsert.newest(spaces, ["user_id"], [F.desc("at"), "workspace_id"], 2)
    return s.join(kept, ["user_id", "workspace_id"], "left_semi").select("id", "user_id", "workspace_id").distinct()


@register("chat_titles", r"select result_id, case when length(t) <= 56 then t else left(t, 53) || '…' end as title from (select result_id, trim(regexp_replace(query, '\s+', ' ', 'g')) as t from query_results)")
def chat_titles(spark, sf_dir):
    return read(spark, sf_dir, "query_results").select("result_id", T.short_title(F.col("query")).alias("title"))


PREVIEW_SQL = r"""select result_id, left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(answer, '<[^>]+>', '', 'g'), '\*\*([^\n]+?)\*\*', '\1', 'g'), '\*([^\n]+?)\*', '\1', 'g'),
  '`([^`]+)`', '\1', 'g'), '#{1,6}@W@', '', 'g'), '@W@+', ' ', 'g'), ' '), 120) as preview from query_results where use_llm and answer is not null""".replace("@W@", T.WHITE_SQL)


@register(
    "chat_previews",
    PREVIEW_SQL,
)
def chat_previews(spark, sf_dir):
    """The first 120 characters of each answer without its markup."""
    q = read(spark, sf_dir, "query_results").where("use_llm and answer is not null")
    return q.select("result_id", F.substring(T.without_markup(F.col("answer")), 1, 120).alias("preview"))


@register("chat_previews_whole", PREVIEW_SQL)
def chat_previews_whole(spark, sf_dir):
    """The same as ``chat_previews``, which once left rows out; tested against a plain loop."""
    return chat_previews(spark, sf_dir)


@register(
    "starred_cap",
    f"""with one as (select * from (select *, row_number() over (partition by user_id, workspace_id, query order by starred_at, id) as n from (select distinct on (id) * from starred_responses)) where n = 1),
    ranked as (select *, row_number() over (partition by user_id order by starred_at desc, id) as r, case right(user_id, 1)::int % 3 when 0 then 10 when 1 then 50 else -1 end as cap from one)
    select user_id, id, starred_at from ranked where cap < 0 or r <= cap""",
)
def starred_cap(spark, sf_dir):
    """A (user, workspace, query) is starred once; each user keeps as many as the plan allows."""
    s = read(spark, sf_dir, "starred_responses").dropDuplicates(["id"])
    one = upsert.latest(s, ["user_id", "workspace_id", "query"], [F.asc("starred_at"), F.asc("id")])
    kind = F.substring("user_id", -1, 1).cast("int") % 3
    cap = F.when(kind == 0, 10).when(kind == 1, 50).otherwise(-1)
    order = [F.desc("starred_at"), F.asc("id")]
    capped = [upsert.newest(one.where(cap == n), ["user_id"], order, n) for n in (10, 50)]
    return one.where(cap < 0).unionByName(capped[0]).unionByName(capped[1]).select("user_id", "id", "starred_at")


@register(
    "prefs_merge",
    """with u as (select distinct user_id from query_results where user_id is not null), own as (select user_id, max(strategy) as strategy from query_results where strategy <> 'default' group by user_id)
    select user_id, coalesce(nullif(strategy, ''), 'page_index') as strategy, 'en' as language, 5 as top_k from u left join own using (user_id)""",
)
def prefs_merge(spark, sf_dir):
    """Defaults under what a user has stored."""
    q = read(spark, sf_dir, "query_results").where("user_id is not null")
    own = q.where("strategy <> 'default'").groupBy("user_id").agg(F.max("strategy").alias("strategy"))
    chosen = F.coalesce(F.nullif("strategy", F.lit("")), F.lit("page_index")).alias("strategy")
    return q.select("user_id").distinct().join(own, "user_id", "left").select("user_id", chosen, F.lit("en").alias("language"), F.lit(5).alias("top_k"))


@register(
    "verification_state",
    """with c as (select user_id, event_id, ts, value from events where event_type = 'signup'), last as (select user_id, max((ts, event_id)) as m, arg_max(ts, (ts, event_id)) as created from c group by user_id),
    tries as (select l.user_id, count(e.event_id) as attempts from last l left join events e on e.user_id = l.user_id and e.event_type = 'error' and e.ts > l.created and e.ts <= l.created + interval 10 minute group by l.user_id)
    select l.user_id, attempts, l.created + interval 10 minute < (select max(ts) from events) as expired, attempts >= 5 as locked from last l join tries using (user_id)""",
)
def verification_state(spark, sf_dir):
    """The latest code of each user (a sign-up), the failed attempts within its ten minutes, whether it has expired or is locked."""
    e = read(spark, sf_dir, "events")
    last = e.where("event_type = 'signup'").groupBy("user_id").agg(F.max_by("ts", F.struct("ts", "event_id")).alias("created"))
    end = F.col("created") + F.expr("interval 10 minutes")
    errors = e.where("event_type = 'error'").select("user_id", F.col("ts").alias("at"))
    tries = last.join(errors, "user_id", "left").groupBy("user_id", "created").agg(F.count(F.when((F.col("at") > F.col("created")) & (F.col("at") <= end), 1)).alias("attempts"))
    now = e.agg(F.max("ts").alias("now"))
    return tries.join(F.broadcast(now), F.lit(True)).select("user_id", "attempts", (end < F.col("now")).alias("expired"), (F.col("attempts") >= 5).alias("locked"))


@register(
    "unique_key_audit",
    """select 'starred_responses' as tab, id as key, count(*) as n from starred_responses group by id having count(*) > 1 union all
    select 'parse_requests', request_id::varchar, count(*) from parse_requests group by request_id having count(*) > 1 union all
    select 'documents', doc_id::varchar, count(*) from documents group by doc_id having count(*) > 1""",
)
def unique_key_audit(spark, sf_dir):
    out = None
    for t, k in (("starred_responses", "id"), ("parse_requests", "request_id"), ("documents", "doc_id")):
        part = upsert.repeated_keys(read(spark, sf_dir, t), [k]).select(F.lit(t).alias("tab"), F.col(k).cast("string").alias("key"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@register("status_totals", "select coalesce(category, 'unknown') as category, case when doc_id % 5 = 0 then 'failed' else 'completed' end as status, count(*) as n from documents group by rollup (coalesce(category, 'unknown'), case when doc_id % 5 = 0 then 'failed' else 'completed' end)")
def status_totals(spark, sf_dir):
    """Counts by category and status with subtotals (an extension of the counts by status)."""
    d = read(spark, sf_dir, "documents").select(F.coalesce("category", F.lit("unknown")).alias("category"), F.when(F.col("doc_id") % 5 == 0, "failed").otherwise("completed").alias("status"))
    return d.rollup("category", "status").agg(F.count("*").alias("n"))


@register("usage_windows", "select user_id, event_type, date_trunc('day', ts) as day, count(*) as n, round(sum(value), 4) as total from events group by all")
def usage_windows(spark, sf_dir):
    """Batch form of the streaming counters: tumbling windows of a day."""
    e = read(spark, sf_dir, "events")
    own = e.groupBy("user_id", "event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return own.select("user_id", "event_type", F.col("w.start").alias("day"), "n", "total")


@register(
    "chat_sessions",
    """with m as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as new from events),
    g as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from m) select user_id, min(ts) as started, max(ts) as ended, count(*) as n from g group by user_id, s""",
)
def chat_sessions(spark, sf_dir):
    """Sessions of activity that end after 30 minutes of silence."""
    e = read(spark, sf_dir, "events")
    own = e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))
    return own.select("user_id", "started", "ended", "n")
