"""Text, template and document queries. Texts are wrapped so that every rule has something to do."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.catalogue.registry import Tables, query
from tallyloom.functions import markup, templates, text, urls
from tallyloom.operators import cells as c
from tallyloom.operators import records
from tallyloom.operators.keyed_log import nest_fields
from tallyloom.schemas import OUTPUT
from tallyloom.scratch import new_path
from tallyloom.sources import documents as d

SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ESC = "\x1b"


def _strip(sql: str) -> str:
    return rf"regexp_replace({sql}, '\A{SPACES}+|{SPACES}+\z', '', 'g')"


@query(
    rf"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(chr(27) || '[1;31m ' || replace(text, ' ', chr(27) || '[0m '), '\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])', '', 'g'), "
    rf"'[\r\n]+', ' ', 'g'), '{SPACES}+', ' ', 'g')) AS text FROM documents"
)
def strip_ansi(t: Tables):
    colored = F.concat(F.lit(f"{ESC}[1;31m "), F.replace("text", F.lit(" "), F.lit(f"{ESC}[0m ")))
    return t.spread("documents").select("doc_id", text.clean_console(colored).alias("text"))


@query("SELECT doc_id, text FROM documents")
def unescape(t: Tables):
    escaped = F.replace("text", F.lit("\n"), F.lit("\\n"))
    return t.documents.select("doc_id", text.unescape_newlines(escaped).alias("text"))


@query(rf"SELECT doc_id, {_strip('text')} AS code FROM documents")
def clean_cell(t: Tables):
    padded = F.concat(F.lit(" \n\t"), F.replace("text", F.lit("\n"), F.lit("\\n")), F.lit("\n\n "))
    return t.spread("documents").select("doc_id", text.clean_cell(padded).alias("code"))


@query("SELECT doc_id, CASE WHEN length(text) > 300 THEN text[1:300] || '...' ELSE text END AS text, text[1:50] AS start FROM documents")
def truncate(t: Tables):
    return t.documents.select("doc_id", text.truncate(F.col("text")).alias("text"), text.prefix(F.col("text"), 50).alias("start"))


def fenced(t: Tables):
    """Every document with one fenced block of Python, one of no language, and interpreter prompts in between."""
    body = F.concat(
        F.lit(" `"), F.col("text"), F.lit("`\n```python\nx = "), F.col("doc_id").cast("string"),
        F.lit("\nprint(x)\n```\n>>> "), F.col("lang"), F.lit("\n```\nnot python at all\n```\n"),
    )
    return t.spread("documents").select("doc_id", body.alias("body"))


FENCED = (
    "(SELECT doc_id, ' `' || text || '`' || chr(10) || '```python' || chr(10) || 'x = ' || doc_id || chr(10) || 'print(x)' || chr(10) || '```' || chr(10) || "
    "'>>> ' || lang || chr(10) || '```' || chr(10) || 'not python at all' || chr(10) || '```' || chr(10) AS body FROM documents)"
)


@query("SELECT doc_id, 'x = ' || doc_id || chr(10) || 'print(x)' AS code FROM documents")
def extract_code(t: Tables):
    return text.extract_code(fenced(t), "body", "code").select("doc_id", "code")


@query(rf"SELECT doc_id, {_strip(chr(39) + ' `' + chr(39) + ' || text || ' + chr(39) + '`' + chr(39))} AS before FROM documents")
def text_before_code(t: Tables):
    return fenced(t).select("doc_id", text.text_before_code(F.col("body")).alias("before"))


@query(
    rf"SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(body, '```[\s\S]*?```'), lambda x: "
    + _strip(r"regexp_replace(replace(x, '`', ''), '(?m)^>>>\s?', '', 'g')")
    + rf"), lambda x: x <> ''), chr(10) || chr(10)) AS prose FROM {FENCED}"
)
def extract_markdown(t: Tables):
    return fenced(t).select("doc_id", text.text_outside_code(F.col("body")).alias("prose"))


@query("SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: i || '. ' || x), chr(10)) AS plan FROM documents")
def numbered_lines(t: Tables):
    return t.documents.select("doc_id", templates.numbered_lines(F.split("text", "\n", -1)).alias("plan"))


@query("SELECT doc_id, array_to_string(string_split(text, '. '), chr(10) || '---' || chr(10)) AS outputs FROM documents")
def concat_outputs(t: Tables):
    return t.documents.select("doc_id", text.join_outputs(F.split("text", r"\. ", -1)).alias("outputs"))


@query(
    "SELECT doc_id, chr(10) || '<TaskTitle>' || chr(10) || source || chr(10) || '</TaskTitle>' || chr(10) || '<TaskDetails>' || chr(10) || text || chr(10) || '</TaskDetails>' || chr(10) || chr(10) AS task, "
    "'**the Task:**' || chr(10) || source || chr(10) || '**code genratin recommendations:**' || chr(10) || chr(10) || text || chr(10) || '============' AS enhanced FROM documents"
)
def task_templates(t: Tables):
    return t.documents.select(
        "doc_id",
        templates.planned_task(F.col("source"), F.col("text")).alias("task"),
        templates.task_text(F.col("source"), F.col("text")).alias("enhanced"),
    )


@query(
    "SELECT doc_id, array_to_string(['', '# ' || source, '## problem description:', text, '', 'Data set Info', '', '### quantitative_analysis', n_chars::VARCHAR, '', "
    "'### qualitative_analysis', lang, '', '## scraped data', '', '### dataset_info', text || array_to_string(['', '', '', '---', ' trian dataset path: ~/train.csv ', '', '', '---', ' test dataset path: ~/test.csv'], chr(10)), "
    "'', '### evaluation_metric', 'None', '', ''], chr(10)) AS document FROM documents"
)
def problem_document(t: Tables):
    info = templates.dataset_info(F.col("text"))
    made = templates.problem_document(
        F.col("source"), F.col("text"), F.col("n_chars"), F.col("lang"), info, F.lit(None).cast("string")
    )
    return t.documents.select("doc_id", made.alias("document"))


@query(
    "WITH d AS (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, 'error name:' || lang || '---' || chr(10) || "
    "array_to_string(l[1:3], chr(10)) || '...' || chr(10) || array_to_string(list_reverse(list_reverse(l)[1:3]), chr(10)) AS digest FROM d"
)
def error_digest(t: Tables):
    return t.documents.select("doc_id", text.error_digest(F.col("lang"), F.col("text")).alias("digest"))


@query(
    "SELECT doc_id, CASE WHEN source LIKE 'http://%' OR source LIKE 'https://%' THEN source ELSE 'https://' || source END || '/' || 'overview' AS url FROM documents"
)
def join_url(t: Tables):
    return t.documents.select("doc_id", urls.join_url(F.col("source"), "overview").alias("url"))


@query(
    "SELECT page_id, CASE WHEN url LIKE '%/' THEN url ELSE url || '/' END AS with_slash, string_split(url, '/')[-1] AS last_part, string_split(url, '/')[-2] AS second_last, "
    "url || CASE WHEN url LIKE '%/' THEN '' ELSE '/' END || 'data' AS data_url FROM pages"
)
def url_parts(t: Tables):
    url = F.col("url")
    return t.pages.select(
        "page_id",
        urls.with_slash(url).alias("with_slash"),
        urls.path_part(url, 1).alias("last_part"),
        urls.path_part(url, 2).alias("second_last"),
        urls.join_url(url, "data").alias("data_url"),
    )


@query(
    "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS stamp, floor(epoch(ts))::BIGINT AS run_id, 'error_' || strftime(ts, '%Y%m%d%H%M%S') || '_' || event_type AS error_name FROM events"
)
def stamps(t: Tables):
    stamp = text.stamp(F.col("ts"))
    return t.events.select(
        "event_id", stamp.alias("stamp"), text.epoch_id(F.col("ts")).alias("run_id"),
        F.concat_ws("_", F.lit("error"), stamp, "event_type").alias("error_name"),
    )


@query("SELECT c_custkey, '| ' || c_custkey || ' | ' || c_name || ' | ' || coalesce(nullif(c_mktsegment, 'BUILDING'), 'nan') || ' |' AS line FROM customer")
def markdown_rows(t: Tables):
    segment = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return t.customer.select("c_custkey", text.markdown_row(F.col("c_custkey"), F.col("c_name"), segment).alias("line"))


@query(
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN value WHEN event_id % 4 = 1 THEN floor(value * 100) * 10 WHEN event_id % 4 = 2 THEN NULL ELSE -value END AS number FROM events"
)
def python_floats(t: Tables):
    shown = F.col("value").cast("string")
    kind = F.col("event_id") % 4
    whole = F.concat(F.floor(F.col("value") * 100).cast("string"), F.lit("_0"))
    source = (
        F.when(kind == 0, F.concat(F.lit("\t"), shown, F.lit(" \n")))
        .when(kind == 1, whole)
        .when(kind == 2, F.concat(shown, F.lit("f")))
        .otherwise(F.concat(F.lit("-"), shown))
    )
    return t.events.select("event_id", text.python_float(source).alias("number"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'caller' ELSE event_type END AS doc_type, user_id::VARCHAR AS owner FROM events")
def override_maps(t: Tables):
    """Defaults overridden by an event's own map where it has the key."""
    defaults = F.create_map(F.lit("doc_type"), F.col("event_type"), F.lit("owner"), F.lit("nobody"))
    owner = F.create_map(F.lit("owner"), F.col("user_id").cast("string"))
    own = F.when(F.col("event_id") % 2 == 0, F.map_concat(owner, F.create_map(F.lit("doc_type"), F.lit("caller")))).otherwise(owner)
    merged = text.override(defaults, own)
    return t.events.select("event_id", merged["doc_type"].alias("doc_type"), merged["owner"].alias("owner"))


@query("SELECT conv_id, turn, to_json({conv_id: conv_id, turn: turn, role: nullif(role, 'user')})::VARCHAR AS record FROM conversations")
def record_json(t: Tables):
    return t.conversations.withColumn("role", F.nullif("role", F.lit("user"))).select(
        "conv_id", "turn", records.as_json("conv_id", "turn", "role").alias("record")
    )


@query(
    "SELECT doc_id AS run_id, text AS problem_description, source AS dataset_info, array_to_string(string_split(text, chr(10)), '|') AS planned_tasks FROM documents"
)
def log_view(t: Tables):
    rows = t.documents.select(
        F.col("doc_id").alias("run_id"), F.col("text").alias("problem_description"), F.col("source").alias("dataset_info"),
        F.split("text", "\n", -1).alias("planned_tasks"), "n_chars",
    )
    return records.log_view(rows, "planner").withColumn("planned_tasks", F.array_join("planned_tasks", "|"))


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS price, l_tax AS tax, CASE WHEN l_returnflag = 'R' THEN l_shipdate END AS returned FROM lineitem"
)
def nested_projection(t: Tables):
    """Columns dropped by name, three fields re-nested, and one field present only under a condition."""
    kept = records.drop_columns(t.lineitem, ["l_suppkey", "l_quantity", "l_discount", "l_linestatus"])
    nested = nest_fields(kept, "money", {"price": "l_extendedprice", "tax": "l_tax"})
    returned = records.if_present(F.col("l_shipdate"), F.col("l_returnflag") == "R").alias("returned")
    return nested.select("l_orderkey", "l_linenumber", "l_partkey", "money.*", returned)


@query()
def html_to_markdown(t: Tables):
    return t.spread("pages").select("page_id", markup.html_to_markdown("html").alias("markdown"))


@query(
    r"SELECT page_id, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS heading, nullif(regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1), '') AS advert "
    "FROM pages WHERE html LIKE '%<article><h1>%'"
)
def page_fields(t: Tables):
    """Inner markup of two elements of every page, by position and by class."""
    found = t.spread("pages").select(
        "page_id", markup.inner_html(F.col("html"), "article > h1:nth-child(1)").alias("heading"), markup.inner_html(F.col("html"), "body > div.ad").alias("advert")
    )
    return found.where(F.col("heading").isNotNull())


MESSAGE_TYPES = {"click": "stream", "view": "execute_result", "error": "error", "signup": "status", "purchase": "status"}


def messages(t: Tables):
    """Events as kernel messages: a user is a request; a signup is the idle status that ends it."""
    kinds = F.create_map(*[F.lit(x) for pair in MESSAGE_TYPES.items() for x in pair])
    shown = F.col("value").cast("string")
    return t.events.select(
        F.col("user_id").alias("parent_id"), F.col("event_id").alias("seq"), kinds[F.col("event_type")].alias("msg_type"),
        F.when(F.col("event_type") == "signup", "idle").when(F.col("event_type") == "purchase", "busy").alias("execution_state"),
        F.lit("stdout").alias("name"), shown.alias("text"), F.create_map(F.lit("text/plain"), shown).alias("data"),
        F.lit("ValueError").alias("ename"), F.col("props").alias("evalue"),
    )


@query(
    "WITH i AS (SELECT user_id, min(event_id) AS idle FROM events WHERE event_type = 'signup' GROUP BY 1) "
    "SELECT e.user_id AS parent_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'stream' WHEN 'view' THEN 'execute_result' ELSE 'error' END AS output_type, "
    "CASE WHEN event_type = 'click' THEN 'stdout' END AS name, CASE WHEN event_type = 'click' THEN value::VARCHAR END AS text, "
    "CASE WHEN event_type = 'view' THEN value::VARCHAR END AS plain, CASE WHEN event_type = 'error' THEN 'ValueError' END AS ename, "
    "CASE WHEN event_type = 'error' THEN props END AS evalue FROM events e LEFT JOIN i USING (user_id) "
    "WHERE event_type IN ('click', 'view', 'error') AND (idle IS NULL OR event_id < idle)"
)
def message_outputs(t: Tables):
    return c.outputs_of(messages(t)).withColumn("plain", F.col("data")["text/plain"]).drop("data")


def outputs(t: Tables):
    """Per event an array of outputs of several types."""
    value = F.col("value").cast("string")
    kind = F.col("event_id") % 4

    def output(**fields):
        return F.struct(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in OUTPUT.fields])

    stream = output(output_type=F.lit("stream"), name=F.lit("stdout"), text=value)
    result = output(output_type=F.lit("execute_result"), data=F.create_map(F.lit("text/plain"), value))
    error = output(output_type=F.lit("error"), ename=F.lit("KeyError"), evalue=F.col("event_type"), traceback=F.array(F.lit("a"), value))
    other = output(output_type=F.lit("display_data"), data=F.create_map(F.lit("image/png"), F.lit("x")))
    odd = output(output_type=F.lit("comm"))
    chosen = F.when(kind == 0, F.array(stream, result)).when(kind == 1, F.array(odd, error)).when(kind == 2, F.array(other)).otherwise(F.array(result, odd))
    return t.events.select("event_id", chosen.alias("outputs"))


@query(
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN value::VARCHAR WHEN 1 THEN 'Error: KeyError' || chr(10) || event_type WHEN 2 THEN '{\"image/png\":\"x\"}' ELSE value::VARCHAR END AS first, "
    "CASE event_id % 4 WHEN 0 THEN 'Text Output:' || chr(10) || value || '|' || value WHEN 1 THEN 'Unknown Output Type: comm|Error: KeyError' || chr(10) || event_type || chr(10) || '[''a'', ''' || value || ''']' "
    "WHEN 2 THEN 'Unknown Display Data' ELSE value || '|Unknown Output Type: comm' END AS texts FROM events"
)
def output_texts(t: Tables):
    return outputs(t).select(
        "event_id", c.first_output(F.col("outputs")).alias("first"), F.array_join(c.output_texts(F.col("outputs")), "|").alias("texts")
    )


@query("SELECT doc_id, i - 1 AS seq, string_split(text, chr(10))[i] AS task FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1))::INTEGER AS i)")
def plan_rows(t: Tables):
    """A plan kept as a JSON array, back as rows."""
    saved = t.documents.select("doc_id", F.to_json(F.split("text", "\n", -1)).alias("plan"))
    return saved.select("doc_id", d.plan_rows(F.col("plan")))


@query(
    "SELECT doc_id, 'lang' AS source, lang AS page_content FROM documents UNION ALL SELECT doc_id, 'text', text FROM documents"
)
def field_rows(t: Tables):
    """A JSON object per document, unpivoted to its fields."""
    saved = t.documents.select("doc_id", F.to_json(F.struct("lang", "text")).alias("fields"))
    return saved.select("doc_id", d.field_rows(F.col("fields")))


@query(
    "SELECT o_orderkey, i AS index, CASE i WHEN '0' THEN o_totalprice ELSE o_custkey::DOUBLE END AS amount, CASE i WHEN '0' THEN o_orderstatus ELSE o_orderpriority END AS label "
    "FROM orders, (VALUES ('0'), ('1')) v(i)"
)
def frame_rows(t: Tables):
    """A column-oriented data-frame text per order, back as rows."""
    def column(a, b):
        return F.create_map(F.lit("0"), a.cast("string"), F.lit("1"), b.cast("string"))

    frame = F.to_json(F.struct(
        column(F.col("o_totalprice"), F.col("o_custkey")).alias("amount"), column(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("label"),
    ))
    schema = T.StructType([T.StructField("amount", T.DoubleType()), T.StructField("label", T.StringType())])
    return t.orders.select("o_orderkey", F.inline(d.frame_rows(frame, schema)))


@query("SELECT doc_id, 0 AS seq, 'markdown' AS cell_type, text AS code, 0 AS n_outputs, NULL::VARCHAR AS said, NULL::VARCHAR AS shown FROM documents UNION ALL SELECT doc_id, 1, 'code', lang, 1, source, source FROM documents")
def notebook_cells(t: Tables):
    """A notebook text per document, back as its cells."""
    lines = F.to_json(F.split("text", "(?<=\n)", -1))
    quoted = lambda c: F.expr(f"substr(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    # Every other notebook has its texts as single strings, as the format allows.
    even = F.col("doc_id") % 2 == 0
    one = F.when(even, lines).otherwise(quoted("text"))
    two, said = F.when(even, F.to_json(F.array("lang"))).otherwise(quoted("lang")), F.when(even, F.to_json(F.array("source"))).otherwise(quoted("source"))
    stream = F.concat(F.lit('[{"output_type":"stream","name":"stdout","text":'), said, F.lit(',"data":{"text/plain":'), said, F.lit("}}]"))
    cell = lambda kind, source, made: F.concat(F.lit(f'{{"cell_type":"{kind}","source":'), source, F.lit(',"outputs":'), made, F.lit("}"))
    book = F.concat(F.lit('{"cells":['), cell("markdown", one, F.lit("[]")), F.lit(","), cell("code", two, stream), F.lit("]}"))
    cells_ = d.notebook_cells(t.documents.select("doc_id", book.alias("book")), "book")
    output = F.get("outputs", F.lit(0))
    return cells_.select("doc_id", "seq", "cell_type", "code", F.size("outputs").alias("n_outputs"), output["text"].alias("said"), output["data"]["text/plain"].alias("shown"))


@query("SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: '`' || x || '`'), ', ') AS packages FROM documents")
def quoted_list(t: Tables):
    return t.documents.select("doc_id", text.quoted_list(F.col("text")).alias("packages"))


@query("SELECT event_id, event_id % 3 <> 1 AS valid FROM events")
def valid_python(t: Tables):
    """Three texts per residue: a statement, an unfinished one, a comment."""
    kind = F.col("event_id") % 3
    code = F.when(kind == 0, F.concat(F.lit("x = "), F.col("value").cast("string"))).when(kind == 1, F.lit("x = (1,")).otherwise(F.lit("# note"))
    return t.events.select("event_id", text.compiles_as_python(code).alias("valid"))


@query(
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS metric, CASE WHEN event_id % 3 = 0 THEN value END AS score, event_id % 3 = 0 AS readable FROM events"
)
def structured_answers(t: Tables):
    """Model answers as JSON: whole, broken, and null."""
    kind = F.col("event_id") % 3
    said = F.to_json(F.struct(F.col("event_type").alias("metric"), F.col("value").alias("score")))
    answer = F.when(kind == 0, said).when(kind == 1, F.concat(F.lit("Sure! "), said))
    parsed = text.parse_answer(answer, "metric string, score double")
    return t.events.select("event_id", parsed.alias("a")).select("event_id", "a.metric", "a.score", F.col("a").isNotNull().alias("readable"))


@query(
    "SELECT source AS notebook, doc_id AS seq, 'code' AS cell_type, text AS code, CASE WHEN doc_id % 7 = 0 THEN 'error' ELSE 'ok' END AS status FROM documents"
)
def cells_log(t: Tables):
    """Cells appended to the log, failed ones marked."""
    runs = t.documents.select(F.col("source").alias("notebook"), F.col("doc_id").alias("seq"), F.col("text").alias("code"), F.lit(None).cast("array<string>").alias("outputs"))
    path = new_path(t.spark, "cells")
    for chosen, status in ((F.col("seq") % 7 != 0, "ok"), (F.col("seq") % 7 == 0, "error")):
        d.append_rows(c.new_cells(runs.where(chosen), status), path)
    return t.spark.read.parquet(path).drop("outputs")
