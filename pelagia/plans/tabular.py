"""Queries: ranking, catalogs, telemetry, clouds, navigation, model tables, parsing."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from pelagia.functions import geometry as G
from pelagia.operators import cloud, codebook, extended as X, image_rows, model, parse, ranking, telemetry as T
from pelagia.plans.register import R, query, r6
from pelagia.plans.views import ctes
from pelagia.session import scratch, written

SC = ctes("scores") + ", sc as (select *, (0.5 * clip + 0.3 * entropy + 0.2 * edge) / 1.25 as raw from scores), s as (select *, round(raw, 6) as score from sc)"


def scored(view):
    weights = {"clip": 0.5, "entropy": 0.3, "edge": 0.2, "laplacian": 0.25}
    parts = {c: F.col(c) for c in ("clip", "entropy", "edge")}
    return view("scores").withColumn("score", F.round(ranking.weighted_score(parts, weights), 6))


@query("vs_weighted_score", f"{SC} select idx, score from s")
def _(view):
    return scored(view).select("idx", "score")


@query("wn_rank", f"{SC} select idx, row_number() over (partition by scene order by score desc, scan)::int as rank from s")
def _(view):
    return ranking.ranked(scored(view), "scene").select("idx", "rank")


@query("so_topk_heap", f"{SC} select idx, score, row_number() over (order by score desc, scan)::int as rank from s order by score desc, scan limit 20")
def _(view):
    return ranking.top_k(scored(view), 20).select("idx", "score", "rank")


@query("wn_neighbor_context", f"""{SC}, w as (select *, coalesce(list(path) over (partition by scene order by scan rows between 5 preceding and 1 preceding), []) as b, coalesce(list(path) over (partition by scene order by scan rows between 1 following and 5 following), []) as a from s)
select idx, array_to_string(b, ';') as before, array_to_string(a, ';') as after from w order by score desc, scan limit 20""")
def _(view):
    df = scored(view)
    found = ranking.with_context(df, ranking.top_k(df, 20))
    return found.select("idx", F.array_join("before", ";").alias("before"), F.array_join("after", ";").alias("after"))


@query("jn_semi_topk", f"{SC}, k as (select scene from s group by scene order by max(score) desc, scene limit 3) select idx from s semi join k using (scene)")
def _(view):
    df = scored(view)
    best = df.groupBy("scene").agg(F.max("score").alias("m")).orderBy(F.desc("m"), "scene").limit(3)
    return df.join(F.broadcast(best), "scene", "left_semi").select("idx")


@query("so_nlargest", "select p_partkey, p_retailprice::double as price from part order by p_retailprice desc, p_partkey limit 15")
def _(view):
    return view("part").select("p_partkey", F.col("p_retailprice").cast("double").alias("price")).orderBy(F.desc("price"), "p_partkey").limit(15)


@query("so_topn_scores", f"{SC} select scene, score from (select scene, max(score) as score from s where score is not null group by scene) order by score desc, scene limit 10")
def _(view):
    return scored(view).where("score is not null").groupBy("scene").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "scene").limit(10)


@query("so_stride_sample", f"{SC}, i as (select idx, scan from s where scan % 7 = 0) select idx from i order by scan limit 40")
def _(view):
    return view("scores").where("scan % 7 = 0").orderBy("scan").limit(40).select("idx")


@query("ss_two_pass", f"{SC}, k as (select * from s order by score desc, scan limit 10) select k.idx, count(*) as near from k join s on s.scene = k.scene and abs(s.scan - k.scan) <= 40 group by k.idx")
def _(view):
    df = scored(view)
    kept = ranking.top_k(df, 10).select("idx", "scene", F.col("scan").alias("at"))
    return df.select("scene", "scan").join(F.broadcast(kept), "scene").where(F.abs(F.col("scan") - F.col("at")) <= 40).groupBy("idx").agg(F.count("*").alias("near"))


_DOT = "list_sum(list_transform(range(1, 65), lambda k: e.embedding[k]::double * q.embedding[k]::double))"
_PR = f"with pr as (select vec_id as prompt, embedding from embeddings where vec_id in (select min(vec_id) from embeddings group by label)), cs as (select e.vec_id, q.prompt, {_DOT} as cos from embeddings e, pr q)"


def prompts(view):
    """The first vector of each label stands for the label's prompt."""
    first = view("embeddings").groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("e"))
    return first.select(F.col("e.vec_id").alias("prompt"), F.col("e.embedding").alias("p"))


@query("vs_cosine_mean", f"{_PR} select vec_id, {R('least(1, greatest(0, (avg(cos) + 1) / 2))')} as score from cs group by vec_id")
def _(view):
    cos = ranking.prompt_scores(view("embeddings"), prompts(view))
    return cos.groupBy("vec_id").agg(r6(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.avg("cos") + 1) / 2))).alias("score"))


@query("vs_softmax_classify", f"{_PR}, e as (select *, exp(10 * (cos - max(cos) over (partition by vec_id))) as e from cs), p as (select *, e / sum(e) over (partition by vec_id) as p from e) select vec_id, arg_max(prompt, (round(p, 9), -prompt)) as cls, {R('max(p)')} as p from p group by vec_id")
def _(view):
    return ranking.classified(view("embeddings"), prompts(view), 10.0).select("vec_id", "cls", r6("p").alias("p"))


CAT = ctes("catalog")


@query("ag_class_balance", f"""{CAT}, p as (select *, n::double / sum(n) over (partition by dataset) as p, row_number() over (partition by dataset order by n, cls) as i from catalog)
select dataset, count(*) as classes, sum(n)::bigint as total, min(n) as lo, max(n) as hi, {R('max(n)::double / min(n)')} as imbalance, {R('-sum(p * ln(p) / ln(2.0::double))')} as entropy,
 {R('pow(2.0::double, -sum(p * ln(p) / ln(2.0::double)))')} as effective, {R('(2 * sum(i * n) / (count(*) * sum(n))::double - (count(*) + 1) / count(*)::double)')} as gini from p group by dataset""")
def _(view):
    w = Window.partitionBy("dataset")
    p = view("catalog").withColumns({"p": F.col("n").cast("double") / F.sum("n").over(w), "i": F.row_number().over(w.orderBy("n", "cls"))})
    entropy = -F.sum(F.col("p") * F.log2("p"))
    gini = 2 * F.sum(F.col("i") * F.col("n")) / (F.count("*") * F.sum("n")).cast("double") - (F.count("*") + 1) / F.count("*").cast("double")
    return p.groupBy("dataset").agg(F.count("*").alias("classes"), F.sum("n").alias("total"), F.min("n").alias("lo"), F.max("n").alias("hi"), r6(F.max("n").cast("double") / F.min("n")).alias("imbalance"), r6(entropy).alias("entropy"), r6(F.pow(F.lit(2.0), entropy)).alias("effective"), r6(gini).alias("gini"))


@query("ag_label_pools", f"{CAT} select cls, sum(n)::bigint as n, array_to_string(list_sort(list(distinct dataset)), ',') as datasets from catalog group by cls")
def _(view):
    return view("catalog").groupBy("cls").agg(F.sum("n").alias("n"), F.array_join(F.sort_array(F.collect_set("dataset")).cast("array<string>"), ",").alias("datasets"))


@query("ag_value_counts", "select event_type, count(*) as n, row_number() over (order by count(*) desc, event_type)::int as place from events where event_type is not null group by 1")
def _(view):
    counts = view("events").where("event_type is not null").groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "event_type")))


@query("ag_label_counter", "select word, count(*) as n from (select trim(unnest(string_split(p_type, ' '))) as word from part) group by word order by n desc, word limit 15")
def _(view):
    words = view("part").select(F.explode(F.transform(F.split("p_type", " "), lambda w: F.trim(w))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(15)


@query("ag_five_num", f"select source, {R('min(n_chars)::double')} as lo, {R('quantile_cont(n_chars, 0.25)')} as q1, {R('quantile_cont(n_chars, 0.5)')} as q2, {R('quantile_cont(n_chars, 0.75)')} as q3, {R('max(n_chars)::double')} as hi from documents group by source")
def _(view):
    q = F.percentile("n_chars", F.array(*(F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0))))
    return view("documents").groupBy("source").agg(q.alias("q")).select("source", *(r6(F.get("q", F.lit(i)).cast("double")).alias(n) for i, n in enumerate(("lo", "q1", "q2", "q3", "hi"))))


@query("ag_scene_rollup", "select source, count(*) as n, count(distinct (lang, n_chars % 7)) as shapes, sum(n_chars)::bigint as size, median(n_chars)::double as mid from documents group by source")
def _(view):
    return view("documents").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct(F.struct("lang", F.col("n_chars") % 7)).alias("shapes"), F.sum("n_chars").alias("size"), F.median("n_chars").alias("mid"))


@query("ag_completeness", f"select source, {R('100.0::double * count(l.doc_id) / count(*)')} as rate, {R('sum(n_chars)::double / count(*)')} as per, max(d.doc_id) - min(d.doc_id) as spread from documents d left join labels l using (doc_id) group by source")
def _(view):
    both = view("documents").join(view("labels").select("doc_id", F.lit(1).alias("has")), "doc_id", "left")
    return both.groupBy("source").agg(r6(100.0 * F.count("has") / F.count("*")).alias("rate"), r6(F.sum("n_chars").cast("double") / F.count("*")).alias("per"), (F.max("doc_id") - F.min("doc_id")).alias("spread"))


@query("ag_dataset_plus_total", f"{CAT} select dataset, sum(n)::bigint as n, count(*) as rows from catalog group by grouping sets ((dataset), ())")
def _(view):
    return view("catalog").groupingSets([["dataset"], []], "dataset").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))


@query("ag_classify_stats", "select source, lang, count(*) as n, count(*) filter (n_chars < 500) as empty from documents group by 1, 2")
def _(view):
    return view("documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") < 500).alias("empty"))


@query("ag_type_summary", "select event_type, count(*) as n, sum(value) > 0 as some, array_to_string(list_sort(list(event_id::varchar))[1:5], ',') as first from events group by 1")
def _(view):
    events, name = view("events"), F.col("event_id").cast("string").alias("name")
    # five names of a type in each task, then five of all: nothing else is gathered
    first = events.select("event_type", name).withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy("name"))).where("r <= 5")
    first = first.groupBy("event_type").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("first"))
    return events.groupBy("event_type").agg(F.count("*").alias("n"), (F.sum("value") > 0).alias("some")).join(first, "event_type")


@query("ag_mean_rms", f"{ctes('telemetry')} select run, {R('avg(value)')} as mean, {R('sqrt(avg(value * value))')} as rms from telemetry group by run")
def _(view):
    return view("telemetry").groupBy("run").agg(r6(F.avg("value")).alias("mean"), r6(F.sqrt(F.avg(F.col("value") * F.col("value")))).alias("rms"))


@query("ag_per_view", f"select lang, source, {R('avg(n_chars)')} as mean, {R('stddev_pop(n_chars)')} as std from documents group by 1, 2")
def _(view):
    return view("documents").groupBy("lang", "source").agg(r6(F.avg("n_chars")).alias("mean"), r6(F.stddev_pop("n_chars")).alias("std"))


@query("ag_bench_summary", f"with u as (select 'quantity' as stat, l_quantity::double as v from lineitem union all select 'discount', l_discount::double from lineitem union all select 'tax', l_tax::double from lineitem) select stat, {R('avg(v)')} as mean, count(*) as n from u group by stat")
def _(view):
    wide = view("lineitem").select(*(F.col(f"l_{c}").cast("double").alias(c) for c in ("quantity", "discount", "tax")))
    return wide.unpivot([], ["quantity", "discount", "tax"], "stat", "v").groupBy("stat").agg(r6(F.avg("v")).alias("mean"), F.count("*").alias("n"))


@query("sink_results_csv", f"select lang, {R('avg(n_chars) filter (source = $$src0$$)')} as src0, {R('avg(n_chars) filter (source = $$src1$$)')} as src1 from documents group by lang union all select 'average', {R('avg(n_chars) filter (source = $$src0$$)')}, {R('avg(n_chars) filter (source = $$src1$$)')} from documents")
def _(view):
    docs = view("documents").where("source in ('src0', 'src1')")
    every = view("documents").select("lang").distinct()
    by = docs.groupBy("lang").pivot("source", ["src0", "src1"]).agg(F.avg("n_chars"))
    all_ = docs.groupBy(F.lit("average").alias("lang")).pivot("source", ["src0", "src1"]).agg(F.avg("n_chars"))
    found = every.join(by, "lang", "left").unionByName(all_).select("lang", r6("src0").alias("src0"), r6("src1").alias("src1"))
    path = scratch(found.sparkSession)
    found.write.option("header", True).csv(path)
    return found.sparkSession.read.schema(found.schema).option("header", True).csv(path)


@query("wn_cumulative_year", "with y as (select year(o_orderdate)::int as yr, count(*) as n from orders group by 1) select yr, n, (sum(n) over (order by yr rows unbounded preceding))::bigint as upto from y")
def _(view):
    counts = view("orders").groupBy(F.year("o_orderdate").alias("yr")).agg(F.count("*").alias("n"))
    return counts.withColumn("upto", F.sum("n").over(Window.orderBy("yr").rowsBetween(Window.unboundedPreceding, 0)))  # a row a year


@query("st_intersect", "select l_suppkey as k from lineitem where l_returnflag = 'R' intersect select l_suppkey from lineitem where l_quantity > 49")
def _(view):
    items = view("lineitem")
    return items.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k")).intersect(items.where("l_quantity > 49").select("l_suppkey"))


@query("st_except", "select c_custkey as k from customer except select o_custkey from orders where o_totalprice > 100000")
def _(view):
    return view("customer").select(F.col("c_custkey").alias("k")).subtract(view("orders").where("o_totalprice > 100000").select("o_custkey"))


@query("st_union_append", "select s_name as name, s_nationkey as nation, null::varchar as segment from supplier union all select c_name, c_nationkey, c_mktsegment from customer")
def _(view):
    a = view("supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return a.unionByName(view("customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")), allowMissingColumns=True)


TL = ctes("telemetry")


@query("wn_ema", f"{TL} select run, {R('list_reduce(list(value order by step), lambda s, x: 0.1 * x + 0.9 * s)')} as ema from telemetry group by run")
def _(view):
    return T.ema(view("telemetry"), 0.1).select("run", r6("ema").alias("ema"))


@query("wn_rolling_trend", f"""{TL}, l as (select run, step, list(value) over (partition by run order by step rows between 199 preceding and current row) as v from telemetry), h as (select *, len(v) as n, len(v) // 2 as h from l)
select run, step, {R('case when n < 10 then 0 else greatest(-3, least(3, (list_sum(v[h + 1:n]) / (n - h) - list_sum(v[1:h]) / h) / (abs(list_sum(v) / n) + 1e-8))) end')} as trend from h""")
def _(view):
    return T.rolling_trend(view("telemetry")).select("run", "step", r6("trend").alias("trend"))


@query("wn_gae", f"{TL}, d as (select run, step, value / 100 + 0.99 * coalesce(lead(value) over (partition by run order by step), 0) - value as d from telemetry) select run, {R('list_reduce(list_prepend(0.0::double, list(d order by step desc)), lambda s, x: x + 0.9405 * s)')} as gae from d group by run")
def _(view):
    return T.gae(view("telemetry")).select("run", r6("gae").alias("gae"))


@query("wn_regions", f"{TL}, k as (select run, step, step - row_number() over (partition by run order by step) as i from telemetry where value > 50) select run, min(step) as start, max(step) + 1 as \"end\" from k group by run, i")
def _(view):
    return T.regions(view("telemetry"), F.col("value") > 50)


@query("wn_sequence_gaps", "with g as (select user_id, event_id as a, lead(event_id) over (partition by user_id order by event_id) as b from events) select user_id, a as \"at\", b as \"to\" from g where b - a > 1")
def _(view):
    return T.gaps(view("events"), "user_id", "event_id")


@query("wn_best_checkpoint", f"{TL}, k as (select *, max(value) over (partition by run order by step rows between unbounded preceding and 1 preceding) as top from telemetry where kind <> 'view') select run, step, {R('value')} as value from k where top is null or value > top")
def _(view):
    return T.best_checkpoints(view("telemetry"), "value", F.col("kind") != "view").select("run", "step", r6("value").alias("value"))


@query("wn_peaks", f"{TL} select run, step, {R('max(value) over w')} as peak, {R('sum(value / 3600) over w')} as energy from telemetry window w as (partition by run order by step rows unbounded preceding)")
def _(view):
    return T.running(view("telemetry")).select("run", "step", r6("peak").alias("peak"), r6("energy").alias("energy"))


@query("wn_calibrate", f"{TL} select run, {R('least(10, greatest(0.1, sqrt(avg(value) / avg(value + 1))))')} as w from telemetry where step <= 20 group by run")
def _(view):
    w = F.sqrt(F.avg("value") / F.avg(F.col("value") + 1))
    return view("telemetry").where("step <= 20").groupBy("run").agg(r6(F.least(F.lit(10.0), F.greatest(F.lit(0.1), w))).alias("w"))


@query("wn_settle", f"{TL}, m as (select run, avg(value) as level, max(step) as last from telemetry group by run) select t.run, coalesce(min(step) filter (abs(value - level) < 1), max(last) + 1)::int as at from telemetry t join m using (run) group by t.run")
def _(view):
    return T.settled(view("telemetry"))


NV = ctes("nav")
_FIRST = "first_value({0}) over (partition by session order by event_id)"


@query("wn_first_row_ref", f"{NV} select session, event_id, {_FIRST.format('lat')} as lat0, {_FIRST.format('lon')} as lon0, {_FIRST.format('alt')} as alt0 from nav")
def _(view):
    nav = view("nav")
    first = written(nav.groupBy("session").agg(*(F.min_by(c, "event_id").alias(f"{c}0") for c in ("lat", "lon", "alt"))))
    return nav.join(first, "session").select("session", "event_id", "lat0", "lon0", "alt0")


@query("sc_gps_to_enu", f"{NV}, f as (select *, {_FIRST.format('lat')} as lat0, {_FIRST.format('lon')} as lon0, {_FIRST.format('alt')} as alt0 from nav) select session, event_id, {R('(lon - lon0) * 111320 * cos(lat0 * pi() / 180)')} as east, {R('(lat - lat0) * 111320')} as north, {R('alt - alt0')} as up from f")
def _(view):
    w = Window.partitionBy("session").orderBy("event_id")
    df = view("nav").withColumns({f"{c}0": F.first(c).over(w) for c in ("lat", "lon", "alt")})
    return df.select("session", "event_id", r6((F.col("lon") - F.col("lon0")) * 111320 * F.cos(F.col("lat0") * F.pi() / 180)).alias("east"), r6((F.col("lat") - F.col("lat0")) * 111320).alias("north"), r6(F.col("alt") - F.col("alt0")).alias("up"))


@query("sc_euler_to_se3", f"{NV} select session, event_id, {R('cos(yaw) * cos(0.1)')} as m00, {R('cos(yaw) * sin(0.1) * sin(0.05) - sin(yaw) * cos(0.05)')} as m01, {R('sin(yaw) * cos(0.1)')} as m10, {R('-sin(0.1::double)')} as m20 from nav")
def _(view):
    m = G.euler_zyx(F.col("yaw"), F.lit(0.1), F.lit(0.05))
    return view("nav").select("session", "event_id", *(r6(m[i]).alias(n) for i, n in ((0, "m00"), (1, "m01"), (3, "m10"), (6, "m20"))))


@query("src_nav_csv", f"{NV}, i as (select *, row_number() over (partition by session order by event_id) - 1 as i from nav) select session, event_id, lat, lon from i where i % 4 = 0")
def _(view):
    w = Window.partitionBy("session").orderBy("event_id")
    return view("nav").withColumn("i", F.row_number().over(w) - 1).where("i % 4 = 0").select("session", "event_id", "lat", "lon")


@query("sc_polar_to_xyz", ctes("sonar_px") + f" select frame, rng, az, {R('(rng + 0.5) / 64 * 10 * cos((az - 24) * pi() / 72)')} as x, {R('(rng + 0.5) / 64 * 10 * sin((az - 24) * pi() / 72)')} as y from sonar_px")
def _(view):
    r, a = (F.col("rng") + 0.5) / 64 * 10, (F.col("az") - 24) * F.pi() / 72
    return view("sonar_px").select("frame", "rng", "az", r6(r * F.cos(a)).alias("x"), r6(r * F.sin(a)).alias("y"))


@query("sc_intrinsics", f"select n_nationkey as k, {R('640 / (2 * tan((40 + n_nationkey) * pi() / 360))')} as focal, {R('2 * atan(640 / (2 * (300.0::double + n_nationkey))) * 180 / pi()')} as fov from nation")
def _(view):
    k = F.col("n_nationkey")
    return view("nation").select(k.alias("k"), r6(640 / (2 * F.tan((40 + k) * F.pi() / 360))).alias("focal"), r6(2 * F.atan(640 / (2 * (300.0 + k))) * 180 / F.pi()).alias("fov"))


@query("sc_depth_to_points", ctes("img_px") + f" select img, py, px, {R('(px + 0.5 - 8) / 20 * v')} as x, {R('(py + 0.5 - 8) / 20 * v')} as y, v::double as z from img_px")
def _(view):
    return image_rows.depth_points(view("img_rows"), 20.0, 8.0, 8.0, 6)


@query("sc_schedule", f"{ctes('telemetry')}, e as (select run, max(step) as n from telemetry group by run) select run, step, {R('least(1, step / 50.0::double)')} as ramp, {R('exp(-step / 40.0::double)')} as decay, {R('exp(ln(0.01::double) * (1 - step / n::double) + ln(0.0001::double) * (step / n::double))')} as lr from telemetry join e using (run)")
def _(view):
    df = view("telemetry")
    ends = written(df.groupBy("run").agg(F.max("step").alias("n")))
    return df.join(ends, "run").select("run", "step", *(r6(c).alias(n) for n, c in parse.schedules(F.col("step"), F.col("n")).items()))


@query("sc_lfm_waveform", f"{ctes('telemetry')} select run, step, {R('cos(2 * pi() * (step * (1000 + run % 10 * 100) + 100.0::double * (step - 1) * step) / 48000)')} as y from telemetry")
def _(view):
    """Each run sends a sweep from a frequency of its own, a sample a step."""
    y = parse.chirp((F.col("step") - 1).cast("double"), 1000 + F.col("run") % 10 * 100, 200.0, 48000.0)
    return view("telemetry").select("run", "step", r6(y).alias("y"))


@query("sc_primary_sonar", "select p_partkey as k, coalesce(nullif(string_split(p_name, ' ')[1], ''), 'Unknown') as first from part")
def _(view):
    return view("part").select(F.col("p_partkey").alias("k"), F.coalesce(F.nullif(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("")), F.lit("Unknown")).alias("first"))


@query("sc_completeness", "select doc_id, (25 * ((n_chars > 500)::int + (lang = 'en')::int + (source <> 'src0')::int + (n_chars % 2 = 0)::int))::int as score from documents")
def _(view):
    flags = [F.col("n_chars") > 500, F.col("lang") == "en", F.col("source") != "src0", F.col("n_chars") % 2 == 0]
    return view("documents").select("doc_id", parse.completeness(*flags).alias("score"))


_SUIT = "least(100, case when n_chars > 5000 then 40 when n_chars > 1000 then 25 else 5 end + case when lang = 'en' then 30 else 10 end + case when source in ('src1', 'src2') then 40 else 0 end)"


@query("sc_suitability_score", f"select doc_id, ({_SUIT})::int as score from documents")
def _(view):
    return view("documents").select("doc_id", parse.suitability().alias("score"))


@query("sc_tier_bands", f"with s as (select n_chars, {_SUIT} as v from documents) select case when v >= 70 then 'high' when v >= 40 then 'mid' when v >= 15 then 'low' else 'none' end as tier, count(*) as n, sum(n_chars)::bigint as chars from s group by 1")
def _(view):
    return view("documents").select("n_chars", parse.tier(parse.suitability()).alias("tier")).groupBy("tier").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("sc_label_taxonomy", "with t(raw, unified) as (values ('click', 'touch'), ('view', 'look'), ('purchase', 'deal')) select event_id, coalesce(unified, 'other') as unified from events left join t on event_type = raw")
def _(view):
    return view("events").select("event_id", parse.unified(F.col("event_type"), {"click": "touch", "view": "look", "purchase": "deal"}).alias("unified"))


@query("sc_file_type", "select page_id, case when lower(url) like '%.html' then 'page' when lower(url) like '%/' then 'dir' when lower(url) like '%.png' then 'image' else 'other' end as kind from pages")
def _(view):
    return view("pages").select("page_id", parse.file_kind(F.col("url"), {".html": "page", "/": "dir", ".png": "image"}).alias("kind"))


@query("sc_digits", "select page_id, try_cast(nullif(regexp_replace(url, '[^0-9]', '', 'g'), '') as bigint) as digits from pages")
def _(view):
    return view("pages").select("page_id", parse.digits(F.col("url")).alias("digits"))


@query("sc_content_tags", "select doc_id, array_to_string(list_filter([case when n_chars > 2000 then 'long' end, case when lang <> 'en' then 'foreign' end, case when text like '%|%' then 'table' end], lambda x: x is not null), ',') as tags from documents")
def _(view):
    tags = parse.tags({"long": F.col("n_chars") > 2000, "foreign": F.col("lang") != "en", "table": F.contains("text", F.lit("|"))})
    return view("documents").select("doc_id", F.array_join(tags, ",").alias("tags"))


@query("flt_completeness_issues", "select doc_id, array_to_string(list_filter([case when n_chars < 200 then 'short' end, case when lang is null then 'lang' end, case when n_chars % 2 = 1 then 'odd' end], lambda x: x is not null), ',') as issues from documents where n_chars < 200 or lang is null or n_chars % 2 = 1")
def _(view):
    issues = parse.tags({"short": F.col("n_chars") < 200, "lang": F.col("lang").isNull(), "odd": F.col("n_chars") % 2 == 1})
    return view("documents").select("doc_id", F.array_join(issues, ",").alias("issues")).where("issues <> ''")


@query("flt_mask_classify", "select doc_id, case when n_chars < 100 then 'area' when n_chars % 10 = 0 then 'solidity' when lang = 'fr' then 'edge' else 'kept' end as verdict from documents")
def _(view):
    verdict = parse.first_match((("area", F.col("n_chars") < 100), ("solidity", F.col("n_chars") % 10 == 0), ("edge", F.col("lang") == "fr")), "kept")
    return view("documents").select("doc_id", verdict.alias("verdict"))


@query("src_sonar_params", "select event_id, coalesce((props::json->>'k')::int, 0) as k, coalesce((props::json->>'hfov')::double, 120.0::double) as hfov from events")
def _(view):
    return view("events").select("event_id", *(c.alias(n) for n, c in parse.params(F.col("props"), "k int, hfov double", {"k": 0, "hfov": 120.0}).items()))


@query("src_cfg_args", "select doc_id, (doc_id * 2)::int as iterations, lang as name from documents")
def _(view):
    text = F.concat(F.lit("Namespace(iterations="), (F.col("doc_id") * 2).cast("string"), F.lit(", name='"), F.col("lang"), F.lit("')"))
    args = view("documents").select("doc_id", parse.namespace(text).alias("a"))
    return args.select("doc_id", F.expr("try_cast(a['iterations'] as int)").alias("iterations"), F.col("a")["name"].alias("name"))


@query("src_gpu_csv", "select event_id, (event_id % 100)::double as util, case when event_id % 3 = 0 then 0.0::double else round(value, 2) end as power from events")
def _(view):
    line = F.concat_ws(", ", (F.col("event_id") % 100).cast("string"), F.when(F.col("event_id") % 3 == 0, "[N/A]").otherwise(F.round("value", 2).cast("string")))
    return view("events").select("event_id", *(c.alias(n) for n, c in parse.csv_doubles(line, ("util", "power")).items()))


@query("src_latest_ckpt", "select source, max_by('val_step' || doc_id, doc_id) as newest from documents group by source")
def _(view):
    return parse.latest(view("documents").select("source", F.concat(F.lit("val_step"), F.col("doc_id")).alias("path")), "source", "path").withColumnRenamed("path", "newest")


CL = ctes("cloud_a", "cloud_b")
_D2 = "round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), 9)"
_KNN = ctes("cloud_a") + f", d as (select a.pid as qid, b.pid, {_D2} as d2 from cloud_a a, cloud_a b), k as (select *, row_number() over (partition by qid order by d2, pid)::int as rank from d)"


@query("jn_knn", f"{_KNN} select qid, pid, {R('d2')} as d2, rank from k where rank <= 4")
def _(view):
    a = view("cloud_a")
    return cloud.nearest(a, a, 4).select("qid", "pid", r6("d2").alias("d2"), "rank")


@query("jn_mean_knn_dist", f"{_KNN} select qid, {R('greatest(avg(d2), 1e-7)')} as d2 from k where rank between 2 and 4 group by qid")
def _(view):
    a = view("cloud_a")
    return cloud.nearest(a, a, 4).where("rank > 1").groupBy("qid").agg(r6(F.greatest(F.avg("d2"), F.lit(1e-7))).alias("d2"))


@query("jn_nearest_cloud", f"""{CL}, d as (select a.pid as p, b.pid as q, {_D2} as d2 from cloud_a a, cloud_b b), x as (select p, sqrt(min(d2)) as d from d group by p), y as (select q, sqrt(min(d2)) as d from d group by q)
select {R('(select avg(d) from x) + (select avg(d) from y)')} as chamfer, {R('greatest((select max(d) from x), (select max(d) from y))')} as hausdorff, {R('(select avg((d <= 0.5)::int) from x)')} as precision_, {R('(select avg((d <= 0.5)::int) from y)')} as recall_""")
def _(view):
    a, b = view("cloud_a"), view("cloud_b")

    def side(q, p, *names):
        d = cloud.nearest(q, p, 1).select(F.sqrt("d2").alias("d"))
        return d.agg(F.avg("d").alias(names[0]), F.max("d").alias(names[1]), F.avg((F.col("d") <= 0.5).cast("double")).alias(names[2]))

    both = side(a, b, "a0", "a1", "a2").crossJoin(side(b, a, "b0", "b1", "b2"))  # one row each
    return both.select(r6(F.col("a0") + F.col("b0")).alias("chamfer"), r6(F.greatest("a1", "b1")).alias("hausdorff"), r6("a2").alias("precision_"), r6("b2").alias("recall_"))


@query("jn_voxel_iou", f"{CL}, a as (select distinct floor(x) as i, floor(y) as j, floor(z) as k from cloud_a), b as (select distinct floor(x) as i, floor(y) as j, floor(z) as k from cloud_b) select (select count(*) from a semi join b using (i, j, k)) as both_, {R('(select count(*) from a semi join b using (i, j, k))::double / (select count(*) from (select * from a union select * from b))')} as iou")
def _(view):
    a, b = (cloud.voxels(view(c), 1.0).withColumn(f, F.lit(1)) for c, f in (("cloud_a", "a"), ("cloud_b", "b")))
    full = a.join(b, ["cx", "cy", "cz"], "full")
    both = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull())
    return full.agg(both.alias("both_"), r6(both / F.count("*")).alias("iou"))


@query("flt_aabb", f"{CL} select pid from cloud_a where x between (select min(x) from cloud_b) and (select max(x) from cloud_b) and y between (select min(y) from cloud_b) and (select max(y) from cloud_b)")
def _(view):
    box = view("cloud_b").agg(*(f(c).alias(n + c) for c in "xy" for f, n in ((F.min, "l"), (F.max, "h"))))
    return view("cloud_a").crossJoin(F.broadcast(box)).where("x between lx and hx and y between ly and hy").select("pid")


@query("ag_scene_bounds", ctes("cloud_a") + f" select {R('min(x)')} as lx, {R('max(x)')} as hx, {R('(min(x) + max(x)) / 2')} as cx, {R('1.1 * greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) / 2')} as radius from cloud_a")
def _(view):
    a = view("cloud_a")
    return a.agg(r6(F.min("x")).alias("lx"), r6(F.max("x")).alias("hx"), r6((F.min("x") + F.max("x")) / 2).alias("cx"), r6(1.1 * F.greatest(*(F.max(c) - F.min(c) for c in "xyz")) / 2).alias("radius"))


@query("ag_scene_scale", ctes("cloud_a") + f", m as (select avg(x) as mx, avg(y) as my, avg(z) as mz from cloud_a) select {R('1.1 * max(sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)))')} as scale from cloud_a, m")
def _(view):
    a = view("cloud_a")
    mid = a.agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    d = sum(((F.col(c) - F.col(f"m{c}")) ** 2 for c in "yz"), (F.col("x") - F.col("mx")) ** 2)
    return a.crossJoin(F.broadcast(mid)).agg(r6(1.1 * F.max(F.sqrt(d))).alias("scale"))


SP, OB = ctes("splats"), ctes("observations")


@query("ag_grad_stats", f"{OB} select gid, {R('sum(grad)')} as grad, count(*) as n, {R('max(radius)')} as radius from observations group by gid")
def _(view):
    return model.grad_stats(view("observations")).select("gid", r6("grad").alias("grad"), "n", r6("radius").alias("radius"))


_POL = ctes("splats", "observations") + ", g as (select gid, sum(grad) / count(*) as avg_, max(radius) as radius from observations group by gid), a as (select s.gid, o, case when o < 0.05 then 'prune' when round(avg_, 9) > 0.0002 and greatest(sx, sy, sz) <= 0.15 then 'clone' when round(avg_, 9) > 0.0002 then 'split' else 'keep' end as action from splats s left join g using (gid))"


@query("dm_policy_default", f"{_POL} select action, count(*) as n, {R('sum(o)')} as o from a group by action")
def _(view):
    acted = model.policy(view("splats"), model.grad_stats(view("observations")), grow=2e-4, small=0.15, least=0.05)
    return acted.groupBy("action").agg(F.count("*").alias("n"), r6(F.sum("o")).alias("o"))


@query("dm_policy_prune", f"{SP} select gid from splats where o >= 0.05 and greatest(sx, sy, sz) <= 0.5")
def _(view):
    return view("splats").where((F.col("o") >= 0.05) & (F.greatest("sx", "sy", "sz") <= 0.5)).select("gid")


@query("dm_duplicate", f"{SP} select gid, o, 0 as copy from splats union all select gid, o, 1 from splats where o > 0.5")
def _(view):
    return model.duplicate(view("splats").select("gid", "o"), F.col("o") > 0.5)


@query("dm_remove", f"{SP} select gid from splats where not (o < 0.3)")
def _(view):
    return view("splats").where(~(F.col("o") < 0.3)).select("gid")


@query("dm_reset_opacity", f"{SP} select gid, {R('1 / (1 + exp(-least(ln(o / (1 - o)), ln(0.01::double / 0.99))))')} as o from splats where o > 0 and o < 1")
def _(view):
    df = view("splats").where("o > 0 and o < 1")
    return df.select("gid", r6(G.sigmoid(F.least(G.logit(F.col("o")), G.logit(F.lit(0.01))))).alias("o"))


_Q = SP + ", b as (select min(x) as lo, max(x) as hi from splats), q as (select gid, x, lo, hi, round_even((x - lo) / (hi - lo) * 65535, 0)::int as q from splats, b)"


@query("dm_quantise", f"{_Q} select gid, q, (q >> 8)::int as hi, (q & 255)::int as lo from q")
def _(view):
    return model.quantise(view("splats"), "x", 16).select("gid", "q", F.shiftright("q", 8).alias("hi"), F.col("q").bitwiseAND(255).alias("lo"))


@query("dm_dequantise", f"{_Q} select gid, {R('q / 65535.0::double * (hi - lo) + lo')} as x, abs(q / 65535.0::double * (hi - lo) + lo - x) <= (hi - lo) / (2 * 65535) + 1e-9 as fine from q")
def _(view):
    return model.dequantise(model.quantise(view("splats"), "x", 16), 16).select("gid", r6("back").alias("x"), (F.abs(F.col("back") - F.col("x")) <= (F.col("high") - F.col("low")) / (2 * 65535) + 1e-9).alias("fine"))


@query("dm_log_transform", f"{SP} select gid, {R('sign(x) * ln(1 + abs(x))')} as x, {R('sign(y) * ln(1 + abs(y))')} as y from splats")
def _(view):
    return view("splats").select("gid", *(r6(G.signed_log(F.col(c))).alias(c) for c in "xy"))


def _fit(i: int) -> str:
    return f"a{i} as materialized (select gid, arg_min(c, (d, c)) as c from (select p.gid, k.c, round(list_sum(list_transform(range(1, 25), lambda j: abs(p.v[j] - k.v[j]))), 9) as d from p, c{i} k) group by gid)"


def _centres(i: int) -> str:
    return f"c{i + 1} as materialized (select c, list(m order by j) as v from (select c, j, round(avg(v[j]), 9) as m from a{i} join p using (gid), range(1, 25) r(j) group by c, j) group by c)"


@query("dm_kmeans", f"""with p as materialized (select vec_id as gid, label as scene, list_transform(embedding[17:40], lambda x: round(x::double, 6)) as v from embeddings), c0 as materialized (select gid as c, v from p where gid in (select min(gid) from p group by scene)), {_fit(0)}, {_centres(0)}, {_fit(1)}, {_centres(1)}, {_fit(2)},
b as (select min(list_min(v)) as l, max(list_max(v)) as h from c2) select gid, c, array_to_string(list_transform(v, lambda x: round_even((x - l) / (h - l) * 63, 0)::int), ' ') as codes from a2 join c2 using (c), b""")
def _(view):
    """A 6-bit codebook of the 24 coefficients of each splat."""
    rows = view("embeddings").select(F.col("vec_id").alias("gid"), F.col("label").alias("scene"), F.transform(F.slice("embedding", 17, 24), lambda x: F.round(x.cast("double"), 6)).alias("v"))
    first = rows.groupBy("scene").agg(F.min_by(F.struct("gid", "v"), "gid").alias("s")).select(F.col("s.gid").alias("c"), F.col("s.v").alias("v"))
    found, centres = codebook.fit(rows, first, 2)
    codes = codebook.quantised(centres, 6).select("c", F.array_join(F.col("q").cast("array<string>"), " ").alias("codes"))
    return found.join(codes, "c").select("gid", "c", "codes")


@query("ud_strategy_iface", f"{_POL} select count(*) as n from (select gid from a where action <> 'prune' union all select gid from a where action in ('clone', 'split'))")
def _(view):
    acted = model.policy(view("splats"), model.grad_stats(view("observations")), grow=2e-4, small=0.15, least=0.05)
    return model.grown(acted).agg(F.count("*").alias("n"))
