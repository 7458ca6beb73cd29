"""Column functions against plain-Python statements of the same rules."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import chunks, markup, slices, templates, text, urls

SAMPLES = [
    "", " ", "plain", "\x1b[31mred\x1b[0m text", "\x1b\x1b[0m[0m nested", "a\r\n\r\nb\tc d e\x1cf\x85", "  lead and trail 　",
    "tab\t\ttab", "line\\nbreak", "```python\nx = 1\n```", "text ```\ny = 2\n``` more ```python\nz(\n``` end", "no fence x = 3",
    "```python\nunclosed = 1", "a `b` c\n>>> d\n>>>e\n```js\ncode\n```\n\n tail", "x" * 299, "x" * 300, "x" * 301, "é" * 301, "x = (1,",
    "\x1b[1;31mbold\x1b[m\x1b]0;t\x07 after", "\n```\n\n\na = 1\n\n\n```\n", "one\ntwo\nthree\nfour\nfive", "​zero width", ">>> prompt\r>>> other",
]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(list(enumerate(SAMPLES)), "i int, s string").repartition(3)


def results(df, column):
    found = {r.i: r.v for r in df.select("i", column.alias("v")).collect()}
    return [found[i] for i in range(len(SAMPLES))]


def same(samples, column, expected):
    for sample, mine, theirs in zip(SAMPLES, results(samples, column), map(expected, SAMPLES)):
        assert mine == theirs, repr(sample)


def test_strip_and_squeeze(samples):
    same(samples, text.strip(F.col("s")), str.strip)
    same(samples, text.squeeze(F.col("s")), lambda s: " ".join(s.split()))


def cases(spark, column, pairs):
    """Literal inputs and results of a column function of `s`."""
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(pairs)], "i int, s string")
    found = {r.i: r.v for r in df.select("i", column.alias("v")).collect()}
    for i, (given, wanted) in enumerate(pairs):
        assert found[i] == wanted, repr(given)


def test_clean_console(spark):
    cases(spark, text.clean_console(F.col("s")), [
        ("", ""),
        ("plain", "plain"),
        ("\x1b[31mred\x1b[0m text", "red text"),
        ("\x1b[1;31mbold\x1b[m", "bold"),
        ("  lead\tand\n\ntrail  ", "lead and trail"),
    ])


def test_truncate_counts_characters(samples):
    same(samples, text.truncate(F.col("s")), lambda s: s[:300] + "..." if len(s) > 300 else s)


def test_code_candidates(spark):
    cases(spark, text.code_candidates(F.col("s")), [
        ("", [""]),
        ("x = 3", ["x = 3"]),
        ("```python\nx = 1\n```", ["x = 1"]),
        ("say ```\ny = 2\n``` more ```python\nz(\n``` end", ["y = 2", "z("]),
        ("\n```\n\n\na = 1\n\n\n```\n", ["a = 1"]),
        ("```python\nunclosed = 1", ["unclosed = 1"]),
    ])


def test_extract_code_keeps_what_compiles(spark):
    df = spark.createDataFrame([("```python\nx = 1\n```\n```\nno python here\n```\n```\ny = 2\n```",), ("just words here",)], "s string")
    assert [r.code for r in text.extract_code(df, "s", "code").collect()] == ["x = 1\n\ny = 2", ""]


def test_text_around_code(spark):
    cases(spark, text.text_before_code(F.col("s")), [
        ("", ""), ("no fence", ""), (" before \n```python\nx\n``` after", "before"), ("```x```", ""), ("a ```b``` c ```d```", "a"),
    ])
    cases(spark, text.text_outside_code(F.col("s")), [
        ("", ""),
        ("a `b` c", "a b c"),
        (">>> first\n>>>second", "first\nsecond"),
        ("before\n```js\ncode\n```\n\n tail", "before\n\ntail"),
        ("```only```", ""),
    ])


def test_error_digest(samples):
    def expected(s):
        lines = s.split("\n")
        return "error name:E---\n" + "\n".join(lines[:3]) + "...\n" + "\n".join(lines[-3:])

    same(samples, text.error_digest(F.lit("E"), F.col("s")), expected)


def test_python_float(spark):
    tried = ["1", " 1.5 ", "1_0", "1__0", "_1", "1e3", ".5", "5.", "1.5f", "1.5d", "0x10", "inf", "-Infinity", "+2", "abc", "", "1 2", "\t7\n", "1e", "--1", "1_0.2_5", "nan"]

    def expected(s):
        try:
            value = float(s)
        except ValueError:
            return None
        return None if value != value else value

    df = spark.createDataFrame([(i, s) for i, s in enumerate(tried)], "i int, s string")
    found = {r.i: r.v for r in df.select("i", text.python_float(F.col("s")).alias("v")).collect()}
    assert [found[i] for i in range(len(tried))] == [expected(s) for s in tried]


def test_urls(spark):
    joined = [("a.b", "https://a.b/sub"), ("http://a.b", "http://a.b/sub"), ("https://a.b/", "https://a.b/sub"), ("a/", "https://a/sub"), ("httpx://q", "https://httpx://q/sub")]
    cases(spark, urls.join_url(F.col("s"), "sub", True), joined)
    cases(spark, urls.join_url(F.col("s"), "sub", False), [("a.b", "http://a.b/sub"), ("https://a.b", "https://a.b/sub")])
    cases(spark, urls.path_part(F.col("s"), 1), [("https://a.b/c/d", "d"), ("a/", ""), ("a", "a")])
    cases(spark, urls.path_part(F.col("s"), 2), [("https://a.b/c/d", "c"), ("a/", "a"), ("a", None)])


def test_override_prefers_the_second_map(spark):
    df = spark.range(1).select(text.override(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3), F.lit("c"), F.lit(4))).alias("m"))
    assert df.first().m == {"a": 1, "b": 3, "c": 4}


def test_unreadable_answers_are_null(spark):
    df = spark.createDataFrame([('{"changes_needed": true, "new_plan": ["a"]}',), ("sorry",), (None,)], "s string")
    parsed = df.select(text.parse_answer(F.col("s"), "changes_needed boolean, new_plan array<string>").alias("p"))
    assert [r.p is not None for r in parsed.collect()] == [True, False, False]


@pytest.mark.parametrize("n", [-1, 1, 2, 3, 10])
def test_slices_follow_python(spark, n):
    random.seed(n)
    rows = [(i, [f"c{j}" for j in range(random.randint(0, 6))], random.randint(-1, 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, a array<string>, idx int")
    found = df.select(
        "i",
        slices.executed_codes(F.col("a"), n).alias("codes"),
        slices.last(F.col("a"), max(n, 0)).alias("last"),
        slices.future_tasks(F.col("a"), F.col("idx")).alias("future"),
        slices.executed_tasks(F.col("a"), F.col("idx")).alias("executed"),
    )
    got = {r.i: r for r in found.collect()}
    for i, a, idx in rows:
        stop = len(a) if n == -1 else n
        codes = a[:-stop:-1] if a else []
        assert got[i].codes == "".join(templates.CODE_CELL + c for c in codes)
        assert got[i].last == (a[-n:] if n > 0 else [])
        assert got[i].future == "".join(f"- {idx + k + 1}. {x}\n" for k, x in enumerate(a[idx + 1 :]))
        done = "".join(f"- {k + 1}. {x}\n" for k, x in enumerate(a[: idx + 1]))
        assert got[i].executed == (templates.NOTHING_EXECUTED if idx + 1 <= 0 else templates.EXECUTED_HEADER + done)


def test_previous_results_of_an_empty_log(spark):
    df = spark.createDataFrame([([],)], "e array<struct<task:string,code:string,result:string>>")
    assert df.select(slices.previous_results(F.col("e"))).first()[0] == templates.NO_PREVIOUS_RESULT


def brute_packing(pieces, size, overlap):
    """Greedy windows stated by index: end as far right as fits, then start again as far left as the overlap allows."""
    spans, start, end = [], 0, 0
    while end < len(pieces):
        total = sum(map(len, pieces[start:end]))
        while end < len(pieces) and (end == start or total + len(pieces[end]) <= size):
            total += len(pieces[end])
            end += 1
        spans.append("".join(pieces[start:end]))
        if end < len(pieces):
            while start < end and (sum(map(len, pieces[start:end])) > overlap or sum(map(len, pieces[start : end + 1])) > size):
                start += 1
    return spans


def test_packing_matches_brute_force():
    random.seed(5)
    for _ in range(300):
        pieces = ["x" * random.randint(1, 12) for _ in range(random.randint(0, 25))]
        size = random.randint(12, 40)
        overlap = random.randint(0, size // 2)
        assert list(chunks._pack(pieces, size, overlap)) == brute_packing(pieces, size, overlap)


def brute_nested(whole, size, overlap, separators):
    """Runs of small pieces are packed, large pieces are split by the separators that are left."""
    separator = next((s for s in separators if s in whole), separators[-1])
    finer = separators[separators.index(separator) + 1 :]
    parts = re.split(f"({re.escape(separator)})", whole) if separator else []
    pieces = [p for p in parts[:1] + [a + b for a, b in zip(parts[1::2], parts[2::2])] if p] if separator else list(whole)
    made, run = [], []
    for piece in [*pieces, None]:
        if piece is not None and len(piece) < size:
            run.append(piece)
            continue
        made += brute_packing(run, size, overlap)
        run = []
        if piece is not None:
            made += brute_nested(piece, size, overlap, finer) if finer else [piece]
    return made


def brute_chunks(whole, size=1000, overlap=200):
    return [c for c in (x.strip() for x in brute_nested(whole, size, overlap, ["\n\n", "\n", " ", ""])) if c]


def test_nested_chunks_match_brute_force_on_whole_texts(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = documents.select("doc_id", "text", chunks.nested_chunks(F.col("text")).alias("c")).collect()
    assert len(rows) == documents.count()
    for row in rows:
        assert row.c == brute_chunks(row.text), row.doc_id


@pytest.mark.parametrize("size,overlap", [(6, 0), (10, 4), (17, 16)])
def test_nested_chunks_match_brute_force_on_random_texts(spark, size, overlap):
    random.seed(size)
    texts = ["".join(random.choice("ab \n\n ") for _ in range(random.randint(0, 120))) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for row in df.select("t", chunks.nested_chunks(F.col("t"), size, overlap).alias("c")).collect():
        assert row.c == brute_chunks(row.t, size, overlap), repr(row.t)


def test_nested_chunks_of_small_cases(spark):
    cases = {"": [], "aaa": ["aaa"], "aa bb cc dd": ["aa bb", "cc dd"], "abcdefghij": ["abcdef", "ghij"], "a\n\nbbbbbb b": ["a", "bbbbb", "b", "b"]}
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    found = df.select("s", chunks.nested_chunks(F.col("s"), size=6, overlap=0).alias("c")).collect()
    assert {r.s: r.c for r in found} == cases


def test_chunk_rows_are_handed_on_in_small_batches(spark):
    from tallyloom.operators import retrieval

    texts = ["word " * 40_000, None, "", "a\n\nb", "\n\n".join("p" * 900 for _ in range(3000))]
    df = spark.createDataFrame([(i, t, {"k": str(i)}) for i, t in enumerate(texts)], "i int, t string, m map<string,string>").coalesce(1)
    for overlap, column in ((True, chunks.nested_chunks(F.col("t"))), (False, chunks.separator_chunks(F.col("t")))):
        found = retrieval.chunk_documents(df, "t", overlap=overlap)
        assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString(), "chunks of a whole batch at once"
        want = df.select("i", "m", F.posexplode(column).alias("chunk_no", "chunk")).collect()
        assert sorted(map(str, found.collect())) == sorted(map(str, want))
    batch = pa.RecordBatch.from_pydict({"i": list(range(300)), "t": ["word " * 20_000] * 300})
    handed = list(chunks._handed_on(batch, "t", chunks.overlapping_chunks))
    assert max(b.nbytes for b in handed) < 2 * chunks.HELD and sum(b.num_rows for b in handed) > 30_000
    beside = pa.RecordBatch.from_pydict({"i": ["x" * 100_000] * 3, "t": ["word " * 20_000] * 3})
    assert max(b.nbytes for b in chunks._handed_on(beside, "t", chunks.overlapping_chunks)) < 2 * chunks.HELD


def test_separator_chunks(spark):
    df = spark.createDataFrame([("aa--bb--cc",), ("",), ("--",), ("toolongpiece--a",)], "s string")
    found = [r[0] for r in df.select(chunks.separator_chunks(F.col("s"), "--", 6)).collect()]
    assert found == [["aa--bb", "cc"], [], [], ["toolongpiece", "a"]]


def test_html_to_markdown(spark):
    cases = {
        "<h1>Big</h1><p>a <b>bold </b>x_y</p>": "Big\n===\n\na **bold** x\\_y",
        "<h3>Goal</h3>go": "### Goal\n\ngo",
        "<ul><li>one<ul><li>sub</li></ul></li><li>two</li></ul>": "* one\n  + sub\n* two",
        "<ol><li>f<li>g</ol>": "1. f\n2. g",
        "<pre>x = 1\n  y_z</pre>": "```\nx = 1\n  y_z\n```",
        "<a href='/q'>link</a><br>z": "[link](/q)  \nz",
        "<script>bad()</script>&copy; &amp;": "© &",
        "<table><tr><th>A</th></tr><tr><td>1</td></tr></table>": "| A |\n| --- |\n| 1 |",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "h string")
    found = {r.h: r.m for r in df.select("h", markup.html_to_markdown("h").alias("m")).collect()}
    assert found == {**cases, None: None}


def test_inner_html_is_the_text_of_the_page(spark):
    inner = "a &amp b &amp; &#38 c &copy\n<!-- x --><BR/><B CLASS=q>d</B ><![CDATA[e]]><?pi?><!doctype z></i>&am"
    pages = [f"<p>\n</p><article><h1>{inner}</H1 ><p>x</p></article>", f"<article><h1>{inner}", "<article><h1/>x</article>", f"<article><h1>{inner}</article>x"]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, h string").orderBy("i")
    found = [r.x for r in df.select(markup.inner_html(F.col("h"), "article > h1:nth-child(1)").alias("x")).collect()]
    assert found == [inner, inner, "", inner]


def test_inner_html(spark):
    page = "<div id='description'><div><div>no</div><div>yes <b>x</b><br>&amp;</div></div></div><div id='other'>o"
    df = spark.createDataFrame([(page,)], "h string")
    found = df.select(
        markup.inner_html(F.col("h"), "#description > div > div:nth-child(2)"), markup.inner_html(F.col("h"), "#other"), markup.inner_html(F.col("h"), "#none")
    ).first()
    assert tuple(found) == ("yes <b>x</b><br>&amp;", "o", None)
    with pytest.raises(ValueError):
        markup.inner_html(F.col("h"), "div[a]")
