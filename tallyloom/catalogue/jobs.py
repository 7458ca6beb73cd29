"""Source, sink and run-loop queries. Sinks are read back, so what was written is what is compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.catalogue.registry import Tables, query
from tallyloom.functions.text import python_float
from tallyloom.functions.urls import with_slash
from tallyloom.local import local_table
from tallyloom.plans import dataset_report, run_loop
from tallyloom.scratch import new_path
from tallyloom.sources import documents as d
from tallyloom.sources import tables as s


@query(
    "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS c_acctbal, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS c_mktsegment, "
    "CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal > 0 END AS positive, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey::BIGINT END AS c_nationkey FROM customer"
)
def csv_scan(t: Tables):
    """A table written with four different missing tokens, read back with inferred types."""
    def gap(keep, value, token):
        return F.when(keep, value.cast("string")).otherwise(F.lit(token))

    key = F.col("c_custkey")
    texts = t.customer.select(
        "c_custkey",
        gap(key % 3 != 0, F.col("c_acctbal"), "NA").alias("c_acctbal"),
        gap(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"), "None").alias("c_mktsegment"),
        gap(key % 5 != 0, F.initcap((F.col("c_acctbal") > 0).cast("string")), "<NA>").alias("positive"),
        gap(key % 4 != 0, F.col("c_nationkey"), "n/a").alias("c_nationkey"),
    )
    path = new_path(t.spark, "csv")
    texts.write.csv(path, header=True)
    return s.read_table(t.spark, path)


@query("SELECT doc_id, quality = 1 AS accepted FROM labels")
def submission_sink(t: Tables):
    path = new_path(t.spark, "submission")
    s.write_submission(t.labels.select("doc_id", (F.col("quality") == 1).alias("accepted"), "toxic"), "doc_id", "accepted", path)
    return s.read_table(t.spark, path)


@query("SELECT o_totalprice AS score, count(*) AS n FROM orders WHERE o_orderkey % 6 <> 0 GROUP BY 1")
def leaderboard_scan(t: Tables):
    """One board per order with a numeric, a missing and a non-numeric score."""
    price = F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice").cast("string"))
    scores = F.array(*[F.struct(v.cast("string").alias("score")) for v in (price, F.lit(None), F.lit("pending"))])
    path = new_path(t.spark, "boards")
    t.orders.select(F.to_json(F.struct(scores.alias("submissions")), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    found = d.read_scores(t.spark, path, one_per_line=True).select(python_float(F.col("score")).alias("score"))
    return found.where(F.col("score").isNotNull()).groupBy("score").agg(F.count("*").alias("n"))


@query(
    "SELECT doc_id, 'text' AS field, text AS value FROM documents "
    "UNION ALL SELECT doc_id, 'lang', CASE WHEN doc_id % 4 <> 0 THEN lang END FROM documents"
)
def field_files_sink(t: Tables):
    """Texts of many lines and fields that may be missing, back under their keys."""
    path = new_path(t.spark, "fields")
    rows = t.documents.select("doc_id", "text", F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("lang"))
    d.write_fields(rows, ["text", "lang"], path, keys=["doc_id"])
    return t.spark.read.schema("doc_id long, value string, field string").json(path).select("doc_id", "field", "value")


@query("SELECT event_id, user_id, event_type FROM events UNION ALL SELECT -1 - event_id, user_id, 'late' FROM events WHERE event_type = 'error'")
def append_sink(t: Tables):
    path = new_path(t.spark, "append")
    rows = t.events.select("event_id", "user_id", "event_type")
    d.append_rows(rows, path)
    late = rows.where("event_type = 'error'").select((-1 - F.col("event_id")).alias("event_id"), "user_id", F.lit("late").alias("event_type"))
    d.append_rows(late, path)
    return t.spark.read.schema(rows.schema).parquet(path)


@query(
    "SELECT doc_id, '{' || chr(10) || '  \"doc_id\": ' || doc_id || ',' || chr(10) || '  \"lang\": \"' || lang || '\"' || chr(10) || '}' AS record FROM documents"
)
def indented_json(t: Tables):
    return t.documents.select("doc_id", d.pretty_json(F.struct("doc_id", "lang")).alias("record"))


@query("SELECT doc_id, text, lang, CASE WHEN doc_id % 4 <> 0 THEN source END AS source FROM documents")
def indented_json_files(t: Tables):
    """Nested records of whole texts written as indented JSON and read back."""
    path = new_path(t.spark, "indented")
    source = F.when(F.col("doc_id") % 4 != 0, F.col("source"))
    d.write_json(t.documents, F.struct("doc_id", "text", F.struct("lang", source.alias("source")).alias("about")), path)
    found = d.read_indented(t.spark, path, "doc_id long, text string, about struct<lang: string, source: string>")
    return found.select("doc_id", "text", "about.lang", "about.source")


@query(
    "SELECT doc_id, split_part(text, chr(10), 1) AS description, CASE WHEN doc_id % 4 <> 0 THEN 'by ' || lang END AS evaluation, "
    "CASE WHEN doc_id % 4 <> 0 THEN upper(lang) END AS metric, length(source) || ' characters' AS data_details FROM documents"
)
def summarized_problems(t: Tables):
    """Three texts of each problem summarized, nested anew, written back and read."""
    evaluation = F.when(F.col("doc_id") % 4 != 0, F.col("lang"))
    problems = t.documents.select("doc_id", F.struct(F.col("text").alias("description"), evaluation.alias("evaluation"), F.col("source").alias("data_details")).alias("scraped_data"))
    judged = dataset_report.summarize_problems(
        problems,
        lambda text: F.split_part(text, F.lit("\n"), F.lit(1)),
        lambda text: F.struct(F.concat(F.lit("by "), text).alias("description"), F.upper(text).alias("metric")),
        lambda text: F.concat(F.length(text).cast("string"), F.lit(" characters")),
    )
    path = new_path(t.spark, "problems")
    judged.write.parquet(path)
    found = t.spark.read.schema(judged.schema).parquet(path)
    return found.select("doc_id", "summarized.description", F.col("summarized.evaluation.description").alias("evaluation"), "summarized.evaluation.metric", "summarized.data_details")


_CLOSED = "CASE WHEN url LIKE '%/' THEN url ELSE url || '/' END"


@query(
    f"SELECT url, CASE WHEN any_known THEN 'kept' ELSE 'made of ' || length(url) END AS dataset_info FROM "
    f"(SELECT {_CLOSED} AS url, bool_or(page_id % 3 = 0) AS any_known FROM pages GROUP BY 1)"
)
def analysis_through_cache(t: Tables):
    """Results stored for a third of the URLs are used, the others are computed and appended; the table is read afterwards."""
    path = new_path(t.spark, "results")
    known = t.pages.where("page_id % 3 = 0").select(with_slash(F.col("url")).alias("url")).distinct().withColumn("dataset_info", F.lit("kept"))
    d.append_rows(known, path)
    cache = t.spark.read.schema(known.schema).parquet(path)
    compute = lambda misses: misses.withColumn("dataset_info", F.concat(F.lit("made of "), F.length("url")))
    _, made = dataset_report.through_cache(cache, t.pages.select("url"), "url", compute)
    d.append_rows(made, path)
    return t.spark.read.schema(known.schema).parquet(path)


@query("SELECT page_id, url, upper(url) AS summary FROM pages")
def summarize_fields(t: Tables):
    rows = t.pages.select("page_id", "url", F.col("url").alias("summary"))
    return dataset_report.summarize_pages(rows, {"summary": F.upper})


@query(
    "SELECT doc_id, CASE WHEN doc_id % 5 - 1 >= len(string_split(text, chr(10))) - 1 THEN '__end__' ELSE 'enhancer' END AS plan_route, "
    "CASE WHEN doc_id % 3 = 0 AND doc_id % 8 > 4 THEN 'fail' WHEN doc_id % 3 = 0 THEN 'reflect_on_error' ELSE '__end__' END AS attempt_route, "
    "CASE WHEN doc_id % 3 <> 0 THEN 'generate' WHEN doc_id % 8 <= 3 THEN 'debug' ELSE 'new_solution' END AS prompt, "
    "CASE WHEN doc_id % 4 = 0 THEN 1 ELSE len(string_split(text, chr(10))) END::INTEGER AS plan_size FROM documents"
)
def routes(t: Tables):
    key, plan = F.col("doc_id"), F.split("text", "\n", -1)
    error = F.when(key % 3 == 0, "yes").otherwise("no")
    changed = F.when(key % 4 == 0, F.lit(True)).when(key % 4 == 1, F.lit(False))
    return t.documents.select(
        "doc_id",
        run_loop.plan_route(key % 5 - 1, plan).alias("plan_route"),
        run_loop.attempt_route(error, key % 8).alias("attempt_route"),
        run_loop.prompt_choice(error, key % 8).alias("prompt"),
        F.size(run_loop.replanned(changed, F.array(F.lit("only")), plan)).alias("plan_size"),
    )


def _generate(df):
    return df.withColumn("prompts", F.concat("prompts", F.array(run_loop.prompt_choice(F.col("error"), F.col("iterations")))))


def _execute(df):
    """A stand-in executor: a run fails as often as its record says."""
    fails = F.size("prompts") <= F.col("failures")
    return df.withColumn("error", F.when(fails, "yes").otherwise("no"))


def _reflect(df):
    return df.withColumn("reflections", F.col("reflections") + 1)


def fresh_runs(t: Tables):
    key = F.col("doc_id")
    return t.documents.select(
        "doc_id", (key % 5).alias("failures"), F.lit(0).alias("iterations"), F.lit("no").alias("error"),
        F.array().cast("array<string>").alias("prompts"), F.lit(0).alias("reflections"),
    )


@query(
    "SELECT doc_id, 2 * least(doc_id % 5 + 1, 3)::INTEGER AS iterations, CASE WHEN doc_id % 5 < 3 THEN '__end__' ELSE 'fail' END AS outcome, "
    "array_to_string(['generate', 'debug', 'new_solution'][1:least(doc_id % 5 + 1, 3)], ',') AS prompts, (least(doc_id % 5 + 1, 3) - 1)::INTEGER AS reflections FROM documents"
)
def solve_task(t: Tables):
    """Generate, execute and reflect for every run; three attempts fit the limit."""
    done = run_loop.solve_task(fresh_runs(t), _generate, _execute, _reflect)
    return done.select("doc_id", "iterations", "outcome", F.array_join("prompts", ",").alias("prompts"), "reflections")


@query(
    "SELECT doc_id, (doc_id % 3)::INTEGER AS index, '__end__' AS route, array_to_string(['task 0 done', 'task 1 done', 'task 2 done'][1:doc_id % 3 + 1], ';') AS log FROM documents"
)
def run_plan(t: Tables):
    """Every run works through its own plan of one to three tasks."""
    size = (F.col("doc_id") % 3 + 1).cast("int")
    plan = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.concat(F.lit("task "), i.cast("string")))
    runs = t.documents.select("doc_id", F.lit(-1).alias("index"), plan.alias("planned_tasks"), F.array().cast("array<string>").alias("log"))

    def enhance(df):
        return df.withColumn("current", F.get("planned_tasks", F.col("index")))

    def solve(df):
        return df.withColumn("log", F.concat("log", F.array(F.concat("current", F.lit(" done"))))).drop("current")

    done = run_loop.run_plan(runs, enhance, solve)
    return done.select("doc_id", "index", "route", F.array_join("log", ";").alias("log"))


@query(
    "SELECT 'text' AS kind, md5(array_to_string(['', '# ' || string_split(url, '/')[3], '## problem description:', html, '', 'Data set Info', '', '### quantitative_analysis', 'a', '', "
    "'### qualitative_analysis', 'b', '', '## scraped data', '', '### dataset_info', 'c', '', '### evaluation_metric', 'd', '', ''], chr(10))) AS value FROM pages "
    "UNION ALL SELECT 'json', md5(string_split(url, '/')[3] || html || 'abrecdnotes') FROM pages"
)
def problem_document_sink(t: Tables):
    """Rendered text and JSON fields per page, written and read back; whole contents compared by hash."""
    host = F.concat_ws("/", F.lit("https:"), F.lit(""), F.get(F.split("url", "/"), F.lit(2)), F.lit(""))
    made = {"quantitative_analysis": "a", "qualitative_analysis": "b", "feature_recommendations": "re", "dataset_info": "c", "evaluation": "d", "important_notes": "notes"}
    problems = t.pages.select(host.alias("challenge_url"), F.col("html").alias("problem_description"), *[F.lit(v).alias(k) for k, v in made.items()])
    path = new_path(t.spark, "problems")
    d.write_problem_documents(problems, path)
    fields = F.from_json("value", ", ".join(f"{c} string" for c in d.DOCUMENT_FIELDS))
    read = {kind: d.read_problem_documents(t.spark, path, kind) for kind in ("text", "json")}
    joined = F.concat(*[fields[c] for c in d.DOCUMENT_FIELDS])
    return read["text"].select(F.lit("text").alias("kind"), F.md5("value").alias("value")).unionByName(
        read["json"].select(F.lit("json").alias("kind"), F.md5(joined).alias("value"))
    )


@query()
def profile_report(t: Tables):
    """The profile of lineitem as one text, the way it is handed to a model."""
    said = dataset_report.analyze(
        t.lineitem, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "", lambda shown: {"qualitative_analysis": shown["dataset_head"]}
    )
    return local_table(t.spark, [tuple(said.values())], "dataset_info string, qualitative_analysis string")
