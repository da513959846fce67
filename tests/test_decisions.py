"""Labels, decisions, tables, question sets, memories and sinks on rows worked out by hand."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kbspark.functions import payloads
from kbspark.functions import text as T
from kbspark.operators import agentic, bm25_table, chunking, corpus, evaluation, labelling, memory, personal, retrieval
from kbspark.sources import files, question_sets, sinks, tables


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def column(spark, values, use, kind="string"):
    made = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in made.select("i", use(F.col("v")).alias("out")).orderBy("i").collect()]


# --- operators that once departed from their rules


def test_job_keeps_its_end(spark):
    end, now = datetime(2024, 1, 1), datetime(2024, 1, 2)
    jobs = spark.createDataFrame([(1, "failed", 1, end), (2, "running", 0, None), (3, "completed", 0, end), (4, "queued", 0, end)], "job_id int, status string, retry_count int, finished_at timestamp")
    changes = spark.createDataFrame([(1, "queued", now), (2, "failed", now), (3, "cancelled", now)], "job_id int, new_status string, at timestamp")
    assert rows(corpus.advance_job(jobs, changes), "job_id", "status", "retry_count", "finished_at") == [(1, "queued", 1, end), (2, "failed", 1, now), (3, "cancelled", 0, now), (4, "queued", 0, end)]


def test_pages_and_names(spark):
    made = spark.createDataFrame([(0, "7", "## Page 3"), (1, "iv", "x ##page  12 and ## Page 3"), (2, None, "Page 4"), (3, "9" * 30, "## PAGE 5"), (4, "", None)], "i int, page string, text string")
    assert rows(made.withColumn("p", payloads.page_from_chunk(F.col("page"), F.col("text"))), "i", "p") == [(0, 7), (1, 12), (2, None), (3, 5), (4, None)]
    assert column(spark, [" 12 p", "p 12", "9" * 30, None, ""], payloads.leading_int) == [12, None, None, None, None]
    assert column(spark, ["C:\\a\\My File.MD", "/x/ＡＢ c.pdf/", "", None], payloads.basename_key) == ["myfile.md", "abc.pdf", "", ""]
    assert column(spark, ["a/b.c.pdf", ".hidden", "noext", "x/y.d/z"], evaluation.stem) == ["b.c", ".hidden", "noext", "z"]


def test_document_rank_takes_the_stem(spark):
    hits = spark.createDataFrame([(1, "x/other.pdf", 1), (1, "docs/report 2024.pdf", 2), (2, "annual.pdf", 1), (3, "pdf", 1)], "query_id int, name string, rank int")
    expected = spark.createDataFrame([(1, "annual report 2024 final"), (2, "pdf"), (3, "a.pdf")], "query_id int, document string")
    assert rows(evaluation.document_rank(hits, expected), "query_id", "document_rank") == [(1, 2), (2, None), (3, 1)]


def test_unknown_source_is_an_error(spark):
    chunks = spark.createDataFrame([("a",), ("b",), (None,)], "source_key string")
    rest, counts = corpus.delete_document(chunks, "a")
    assert rest.count() == 2 and tuple(counts.first()) == (1, 1)
    with pytest.raises(Exception, match="no chunk of 'c'"):
        corpus.delete_document(chunks, "c")[1].collect()


def test_memories_of_two_types_with_one_key(spark):
    day = datetime(2024, 1, 1)
    said = [("o", "s", "fact", "k", "a", day, 1), ("o", "s", "profile", "k", "b", day, None), ("o", "x", "fact", "k", "z", datetime(2024, 2, 1), 1)]
    made = spark.createDataFrame(said, "owner string, session_id string, memory_type string, key string, value string, at timestamp, ttl_days int")
    got = memory.upsert_memory(made, spark.createDataFrame([("s", "o"), ("x", "p")], "session_id string, owner string"))
    assert rows(got, "memory_type", "value", "expires_at") == [("fact", "a", datetime(2024, 1, 2)), ("profile", "b", datetime(2024, 3, 31))]
    facts = [("s", "task", "a", "1", 0.5, 2, 1), ("s", "task", "b", "2", 0.5, 1, 2), ("s", "task", "a", " ", 0.9, 1, 3)]
    got = memory.upsert_facts(spark.createDataFrame(facts, "session_id string, memory_type string, key string, value string, confidence double, sort_order int, seq int"))
    assert rows(got, "place", "key", "value", "confidence", "sort_order") == [(1, "a", " ", 0.9, 1), (2, "b", "2", 0.5, 1)]


def test_chunks_count_all_parts_and_take_tables(spark):
    md = "### T\n\n| a |\n| --- |\n| 1 |\n| 22 |"
    docs = [(0, "s", None, None, "# Title\n\n" + "word " * 20), (1, "s", 3, "text", "word " * 20 + "\n\nother words here that are long enough to be alone"), (2, "s", None, "table", md), (3, "t", None, "text", None), (4, "t", None, "text", "Contents\nA .... 3")]
    made = chunking.build_chunks(spark.createDataFrame(docs, "doc_id long, source_path string, page int, content_type string, text string"), 100, 0)
    got = made.orderBy("doc_id", "chunk_index").collect()
    # The title alone goes but counts; the second document's first part stands in the first one's source already.
    assert [(r.doc_id, r.chunk_index, r.content_type) for r in got] == [(0, 1, "text"), (1, 1, "text"), (2, 0, "table"), (2, 1, "table_row"), (2, 2, "table_row")]
    assert got[2].text == md and got[4].text == "### T\n\n| a |\n| --- |\n| 22 |"
    assert got[1].chunk_id == rows(made.limit(1).select(T.chunk_id(F.lit("s"), F.lit(3), F.lit("1"), F.lit("1"), F.lit(got[1].text)).alias("x")), "x")[0][0]


def test_cleaning_by_type(spark):
    text = "Contents\nPart one .... 3\nHeader\n\n\nA  line\nthat wraps\n\nHeader\n Page 3 of 9\n# Head\nend.\nend."
    assert column(spark, [text, None, ""], lambda c: chunking.clean_extracted_text(c, F.lit("pdf"))) == ["A line that wraps\n\n# Head end. end.", None, ""]
    assert column(spark, [" a \r\n\r\n\r\nb"], lambda c: chunking.clean_extracted_text(c, F.lit(None).cast("string"))) == ["a\n\nb"]


def test_parser_key_sample_and_toc(spark):
    made = spark.createDataFrame([("h", "p", "1"), ("h", "p", "2")], "a string, b string, c string").select(corpus.parser_cache_key("a", "b", "c").alias("k"))
    assert made.distinct().count() == 2 and all(len(r.k) == 64 for r in made.collect())
    asked = spark.range(50).withColumnRenamed("id", "query_id")
    assert rows(evaluation.sample_questions(asked, 3), "query_id") == [(0,), (1,), (2,)] and evaluation.sample_questions(asked, 0).count() == 50
    assert rows(evaluation.sample_questions(asked, 7, 42), "query_id") == rows(evaluation.sample_questions(asked.orderBy(F.desc("query_id")), 7, 42), "query_id")
    assert column(spark, ["Table of Contents\n1.2 A ..... 12\nPage 3\ntext\n目录\n第 3 页"], chunking.drop_toc_lines) == ["text"]


# --- labels


QA = "question_id int, question string, answer string, evidence string, source_document string, source_path string, source_chunk string"
CHUNK = "chunk_id string, doc_ix int, chunk_index int, source_name string, source_path string, page int, text string"


def test_identifiers(spark):
    got = column(spark, ["See A-1234, ab/CD and r2.d2@x-y.org; é b 12", "für", None], labelling.identifiers)
    assert got == [["see", "a-1234", "ab/cd", "and", "r2.d2@x-y.org"], [], []]


def test_labels(spark):
    text = "The pump P-1007 needs 5 bar.\n## Page 8\nMore of it."
    questions = [
        (1, "1?", "5 bar", "the  pump P-1007 NEEDS 5 bar", "Manual.PDF", None, "8"), (2, "1?", "", "", None, "C:\\in\\manual.pdf", None), (3, "1?", None, "nothing", "gone.pdf", "manual.pdf", None),
        (4, "2?", "", "1234567 1234567", "ties.md", None, "7"),
    ]
    chunks = [
        ("c1", 0, 0, "manual.pdf", "/a/manual.pdf", None, text), ("c2", 0, 1, "manual.pdf", "/a/manual.pdf", 9, "unlike"), ("c0", 0, 2, "other", "/b/MANUAL.pdf", None, None),
        ("t3", 2, 0, "ties.md", "", 1, "12345671"), ("t2", 1, 5, "ties.md", "", 1, "12345671"), ("t1", 1, 5, "ties.md", "", 1, "12345671"),
    ]
    got = {r.question_id: r for r in labelling.label_questions(spark.createDataFrame(questions, QA), spark.createDataFrame(chunks, CHUNK)).collect()}
    one = got[1]
    assert (one.chunk_id, one.status, one.page, one.evidence_score, one.answer_score, one.page_score, one.identifier_score) == ("c1", "matched", 8, 1.0, 1.0, 1.0, 1.0)
    assert one.score == pytest.approx(0.62 + 0.16 + 0.10 + 0.08) and one.preview == "The pump P-1007 needs 5 bar. ## Page 8 More of it."
    assert (got[2].chunk_id, got[2].status, got[2].score) == ("c1", "low_confidence", 0.0)
    assert (got[3].chunk_id, got[3].status, got[3].score) == (None, "source_not_found", 0.0)
    assert got[4].chunk_id == "t1" and got[4].status == "matched" and got[4].evidence_score == pytest.approx(6 / 7)
    assert rows(labelling.label_statuses(labelling.label_questions(spark.createDataFrame(questions, QA), spark.createDataFrame([], CHUNK))), "status", "questions") == [("source_not_found", 4)]


def test_labels_recall_is_that_of_grams(spark):
    """Grams of the expected text that the chunk holds are those that both sets have."""
    import random

    r = random.Random(3)
    pairs = [("".join(r.choice("abc ") for _ in range(r.randrange(0, 9))), "".join(r.choice("abc ") for _ in range(r.randrange(0, 30)))) for _ in range(300)]

    def brute(expected, actual):
        expected, actual = expected.replace(" ", ""), actual.replace(" ", "")
        grams = lambda t: ({t} if len(t) <= 3 else {t[i : i + 3] for i in range(len(t) - 2)}) if t else set()
        return 0.0 if not expected else 1.0 if expected in actual else len(grams(expected) & grams(actual)) / len(grams(expected))

    made = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, e string, a string").select("i", T.squeeze(F.col("e")).alias("e"), T.squeeze(F.col("a")).alias("a"))
    got = rows(made.withColumn("g", labelling.wanted_grams(F.col("e"))).withColumn("r", labelling.recall(F.col("e"), F.col("g"), F.col("a"))), "i", "r")
    assert dict(got) == {i: pytest.approx(brute(*p)) for i, p in enumerate(pairs)}


def test_labels_make_grams_once_for_each_text(spark):
    """What labels score in Python is what `recall` says, and the plan has no search for each gram."""
    import random

    r = random.Random(4)
    text = lambda n: "".join(r.choice("ab\U0001f600") for _ in range(r.randrange(n)))
    questions, chunks = [(i, text(9), text(9), text(12), "a.md", None, None) for i in range(40)], [(f"c{i}", i, 0, "a.md", None, None, text(30)) for i in range(1)]
    made = labelling.label_questions(spark.createDataFrame(questions, QA), spark.createDataFrame(chunks, CHUNK))
    assert "_grams" not in made._jdf.queryExecution().analyzed().toString()
    e, g, t = F.col("e"), F.col("g"), F.lit(chunks[0][6])
    for c, at in (("question", 1), ("answer", 2), ("evidence", 3)):
        said = spark.createDataFrame([(q[0], q[at]) for q in questions], "i int, e string").withColumn("g", labelling.wanted_grams(e)).withColumn("r", labelling.recall(e, g, t))
        assert rows(made, "question_id", f"{c}_score") == rows(said, "i", "r")


def test_containing_texts(spark):
    item = "one two three four five six seven eight nine"
    items = spark.createDataFrame([(1, item), (2, "short one"), (3, item + " ten"), (4, None)], "query_id int, text string")
    texts = [(1, f"xx{item}yy"), (2, item.replace(" ", "\n")), (3, "a short one here"), (4, None), (5, f"{item} ten"), (6, item.replace("five", "5"))]
    got = evaluation.containing(items, spark.createDataFrame(texts, "chunk_id int, text string"))
    assert rows(got, "query_id", "chunk_id") == [(1, 1), (1, 5), (2, 3), (3, 5)]


# --- decisions


SOURCE = "question_id int, pos int, chunk_id string, source_path string, source_name string, text string"


def _sources(spark):
    return spark.createDataFrame(
        [(1, 1, "c1", "p/a", "Name", "aaa"), (1, 2, "c2", "", "solo", "bbb"), (1, 3, "c3", "p/b", "name", "ccc"), (1, 4, "c4", "p/a", "other", "ddd"), (2, 1, "c1", "p/z", None, None)], SOURCE
    )


def test_references(spark):
    refs = [(1, i, r) for i, r in enumerate([" d3 ", "NAME", "2", "P/A", "Solo", "", None, "D9", "other"])] + [(2, 0, "1"), (2, 1, "d1"), (3, 0, "1")]
    got = agentic.resolve_document_refs(spark.createDataFrame(refs, "question_id int, pos int, ref string"), _sources(spark))
    # The later of two documents of one name has it.
    assert rows(got, "question_id", "place", "document_key") == [(1, 1, "p/b"), (1, 2, "solo"), (1, 3, "p/a"), (2, 1, "p/z")]
    chunks = agentic.resolve_chunk_refs(spark.createDataFrame([(1, "c4"), (1, " 2 "), (1, "9"), (2, "4")], "question_id int, ref string"), _sources(spark))
    assert rows(chunks, "question_id", "document_key") == [(1, "p/a"), (1, "solo")]


@pytest.mark.parametrize(
    "kept, rejected, decision, stays, gone",
    [
        ([], [], "all", ["c1", "c2", "c3", "c4"], []), (["p/a"], ["p/a", "p/b"], "kept", ["c1", "c4"], ["c3"]), ([], ["p/a", "solo", "p/b", "unknown"], "rejected", [], ["c1", "c2", "c3", "c4"]),
        ([], ["p/a", "solo"], "all", ["c1", "c2", "c3", "c4"], []), (["unknown"], ["p/a"], "all", ["c1", "c2", "c3", "c4"], []),
    ],
)
def test_filter(spark, kept, rejected, decision, stays, gone):
    table = lambda keys: spark.createDataFrame([(1, k) for k in keys], "question_id int, document_key string")
    got = agentic.filter_documents(_sources(spark), table(kept), table(rejected)).collect()
    mine = [r for r in got if r.question_id == 1]
    assert {r.decision for r in mine} == {decision} and sorted(r.chunk_id for r in mine if r.kept) == stays and sorted(r.chunk_id for r in mine if r.rejected) == gone
    assert [(r.decision, r.kept) for r in got if r.question_id == 2] == [("all", True)]


def test_judgement(spark):
    schema = "question_id int, question string, rewritten string, attempts int, rejected int, tried array<string>, judged boolean, sufficient string, offered_strategy string, offered array<string>"
    asked = [
        (1, "what is it now", None, 0, 0, None, None, None, None, None), (2, "what is it now", None, 1, 2, None, None, None, None, None), (3, "what is it now", None, 2, 2, None, None, None, None, None), (4, "怎么处理", None, 0, 0, None, True, "no", None, None),
        (5, "long question", "", None, 0, None, True, "true", None, None), (6, "long question", "", 0, 0, None, False, "no", None, None), (7, "long question", "", 0, 0, ["X"], True, "no", "narrow", ["x", " y "]),
        (8, "long question", "", 0, 0, ["x"], True, "no", "", ["x"]), (9, "long question", "", 2, 0, None, True, "0", "narrow", ["z"]), (10, "long question", "", 0, 0, None, True, None, None, None),
    ]
    sources = spark.createDataFrame([(4, "enough of it"), (5, "abc"), (5, " de\n"), (6, "enough of it"), (7, "enough of it"), (8, "enough of it"), (9, "12345678"), (10, "enough of it")], "question_id int, text string")
    got = {r.question_id: (r.action, r.strategy) for r in agentic.judge_action(spark.createDataFrame(asked, schema), sources).collect()}
    limited = "evidence_limited_answer"
    assert got == {
        1: ("retry", "broaden"), 2: ("retry", "keyword"), 3: (limited, "none"), 4: ("clarify", "none"), 5: ("retry", "query_rewrite"), 6: ("generate", "none"), 7: ("retry", "narrow"), 8: (limited, "query_rewrite"),
        9: (limited, "none"), 10: ("generate", "none"),
    }
    after = spark.createDataFrame([("no", 1, 0, 0), ("no", 0, 0, 0), ("no", 1, 2, 0), ("no", 1, 1, 1), (None, 1, 0, 0)], "s string, n int, a int, r int")
    assert [r[0] for r in after.select(agentic.verification_action(F.col("s"), F.col("n"), F.col("a"), F.col("r"))).collect()] == ["retry", "end", "end", "end", "end"]


def test_attempts_and_digests(spark):
    made = spark.createDataFrame([(1, 1, 0, ["a", " b"]), (1, 2, 1, ["a", ""]), (1, 1, 2, ["c"]), (2, 1, 0, None)], "question_id int, attempt int, pos int, queries array<string>")
    assert rows(agentic.attempt_log(made), "question_id", "place", "attempt", "queries") == [(1, 1, 2, ["a", ""]), (1, 2, 1, ["c"]), (2, 1, 1, None)]
    assert rows(agentic.attempted_queries(made), "question_id", "place", "query") == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c")]
    assert rows(agentic.source_snippets(_sources(spark), 2, 2), "question_id", "snippets") == [(1, "[1] chunk_id=c1 source=Name: aa\n\n[2] chunk_id=c2 source=solo: bb"), (2, "[1] chunk_id=c1 source=: ")]
    got = rows(agentic.document_snippets(_sources(spark)).where("question_id = 1"), "number", "snippet")
    assert got[0] == (1, "[D1] source_path=p/a source_name=Name\n- chunk_id=c1: aaa\n- chunk_id=c4: ddd") and [n for n, _ in got] == [1, 2, 3]


# --- tables and question sets


def test_html_tables_golden(spark):
    pages = [
        (1, "<table><tr><td colspan=2>T &amp; x</td></tr><tr><th rowspan='2'>a</th><th>b</th></tr><tr><td>1<br>2</td></tr></table>"),
        (2, "<TABLE><TR><TD rowspan=9 colspan=2>big</TD><TD>x</TD></TR><tr></tr><TR><TD rowspan=0 colspan='no'>y</TD></TR></TABLE><table><tr><td>lone"), (3, None), (4, "<table></table>"),
        (5, "<table><tr><td>lost<td>kept</td></tr></table><p>x</p><table><tr><td title='a>b'> s&nbsp; <!-- no --> p </td><td></td></tr></table>"),
        (6, "<table><tr><td rowspan=2>a</td><td rowspan=3>b</td></tr><tr><td>c</td><td>d</td></tr><tr><td>e</td></tr></table>"),
    ]
    got = rows(tables.html_tables(spark.createDataFrame(pages, "page_id int, html string"), title="none"), "page_id", "table", "title", "headers", "rows", "grid")
    assert got == [
        (1, 0, "T & x", ["a", "b"], [["12"]], [["T & x", "T & x"], ["a", "b"], ["a", "12"]]),
        (2, 0, "none", ["big", "x"], [["y"]], [["big", "big", "x"], ["big", "big", "y"]]),
        (5, 0, "none", ["kept"], [], [["kept"]]), (5, 1, "none", ["s p", ""], [], [["s p", ""]]),
        (6, 0, "none", ["a", "b"], [["c", "d"], ["e"]], [["a", "b"], ["a", "b", "c", "d"], ["e", "b"]]),
    ]
    assert tables.fill_grid([[("a", 3, 1), ("b", 1, 1)], [], [("c", 1, 2)]]) == [["a", "b"], ["a"], ["a", "c", "c"]] and tables.fill_grid([]) == []


def test_delimited_texts_are_parsed_a_few_at_a_time():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"path": [f"/{i}" for i in range(1000)], "text": [f"a,b\n{i},\n" if i % 3 else None for i in range(1000)]})
    made = list(tables._parsed(1, ",")([batch]))
    assert max(b.num_rows for b in made) <= tables.AT_ONCE < 1000
    got = pa.Table.from_batches(made).to_pydict()
    assert got["path"] == [f"/{i}" for i in range(1000)]
    assert got["_rows"] == [[["a", "b"], [str(i), ""]] if i % 3 else [] for i in range(1000)]


def test_delimited_tables(spark):
    got = tables.delimited_table(spark.createDataFrame([("/x/my.file.csv", '\n , \n a,"b, ""c"""\n1\n2,3,4\n'), ("/x/empty", None)], "path string, text string"))
    assert rows(got, "title", "headers", "rows", "markdown") == [
        ("empty", [], [], "### empty"), ("my.file", ["a", 'b, "c"'], [["1"], ["2", "3", "4"]], '### my.file\n\n| a | b, "c" |\n| --- | --- |\n| 1 |  |\n| 2 | 3 |'),
    ]


def test_question_sets_golden(spark):
    md = "\n".join([
        "Question: before any id", "| TQ-1 | d | k | q | e | c1 |", "| TQ-2 | d | k | q |", " | TQ-3 | d | k | q | e |", "| TQ-4 | d | | q | e", "## B1 ", "Document: doc: one", "Question: first", "Question: last",
        'History JSON: [{"role": "user", "content": "x"}]', "Unknown: y", "no colon", "## B2", "Keyword: k", "## ", "Question: no id", "## B3", "Question: q3", "History JSON: {}",
    ])
    csv = '﻿id,question,history_json,History JSON,extra\nA, q one ,"[]","[{""role"": ""user"", ""content"": ""a, b""}]",z\nB,"two\nlines",nope,,\nC\n'
    got = question_sets.parse_question_set(spark.createDataFrame([("s.md", md), ("s.CSV", csv), ("n.md", None), ("n.csv", None), ("e.csv", "")], "path string, text string"))
    made = [(r.path, r.kind, r.id, r.document, r.question, r.expected_chunk_id, [(m.role, m.content) for m in r.history], r.error) for r in got.orderBy("path", "kind", "place").collect()]
    assert made == [
        ("s.CSV", 0, "A", "", "q one", "", [("user", "a, b")], None), ("s.CSV", 0, "B", "", "two\nlines", "", [], None), ("s.CSV", 0, "C", "", "", "", [], None),
        ("s.md", 1, "TQ-1", "d", "q", "c1", [], None), ("s.md", 1, "TQ-4", "d", "q", "", [], None),
        ("s.md", 2, "B1", "doc: one", "last", "", [("user", "x")], None), ("s.md", 2, "B3", "", "q3", "", [], "History JSON must be a list"),
    ]
    wrong = ["[1]", '[{"role": "user"}]', '[{"role": "user", "content": null}]', "[", "3", '"x"', "[]", "", None]
    assert column(spark, wrong, lambda c: question_sets.parse_history(c)[1]) == [*["History JSON items require string role and content"] * 3, "invalid History JSON", *["History JSON must be a list"] * 2, None, None, None]


# --- sinks


def test_a_failed_write_leaves_the_old_partitions(spark, tmp_path):
    path, schema = f"file://{tmp_path}/t", "id int, p string"
    read = lambda: sorted(tuple(r) for r in spark.read.schema(schema).parquet(path).collect())
    sinks.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], schema), path, ["p"])
    sinks.replace_partitions(spark.createDataFrame([(9, "b")], schema), path, ["p"])
    assert read() == [(1, "a"), (9, "b")]
    broken = spark.createDataFrame([(i, "b") for i in range(100)], schema).repartition(4).withColumn("id", F.when(F.col("id") == 77, F.raise_error(F.lit("broken")).cast("int")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="broken"):
        sinks.replace_partitions(broken, path, ["p"])
    assert read() == [(1, "a"), (9, "b")]


def test_reports_come_back(spark, tmp_path):
    path = f"file://{tmp_path}/report"
    questions = spark.createDataFrame([("q1", 'a "quoted", text', ["c1", "c2"]), ("q2", None, [])], "id string, question string, ids array<string>")
    records = spark.createDataFrame([("q1", "old"), ("q2", "x")], "id string, answer string")
    for answer in ("old", "new"):
        sinks.write_report(path, spark.createDataFrame([(0.5, 3)], "mrr double, n int"), questions, records.withColumn("answer", F.lit(answer)))
    assert tuple(spark.read.json(f"{path}/summary").select("mrr", "n").first()) == (0.5, 3)
    assert rows(spark.read.option("header", True).option("escape", '"').csv(f"{path}/questions"), "id", "question", "ids") == [("q1", 'a "quoted", text', "c1;c2"), ("q2", None, None)]
    assert rows(files.load_answer_records(spark, f"{path}/records", "id string, answer string"), "id", "answer") == [("q1", "new"), ("q2", "new")]


def test_fingerprint(spark):
    made = [("a", "1"), ("b", "2"), ("c", "3")]
    of = lambda rows, *more: tuple(sinks.source_fingerprint(spark.createDataFrame(rows, "relative string, file_hash string"), *more).first())
    one = of(made)
    assert one == of(made[::-1]) and len(one[0]) == 64 and len(one[1]) == 24
    assert len({one, of(made[:2]), of([("a", "1"), ("b", "3"), ("c", "2")]), of(made, False), of(made, True, "/root"), of(made, True, None, "kb2")[:1]}) == 6


# --- memories


def test_personal_payloads(spark):
    message = " I work as a  nurse and my cat is Tom. 我喜欢茶 "
    good = {"memory_type": "fact", "key": "cat", "value": "Tom", "confidence": 0.9, "evidence": "my cat  is Tom"}
    pack = lambda *entries, **more: json.dumps({"memories": list(entries)} | more, ensure_ascii=False)
    right = [pack(good), "```json\n" + pack(good, good | {"key": "CAT", "value": "x"}) + "\n```", pack(good | {"ttl_days": 365}), pack(good | {"ttl_days": None, "confidence": 1}), pack(good | {"evidence": "我喜欢茶", "key": "茶"})]
    wrong = [
        pack(good, good | {"key": "x", "evidence": "not said by me"}), pack(good | {"evidence": "is Tom"}), pack(good | {"value": "my password"}), pack(good | {"confidence": True}), pack(good | {"confidence": 1.01}),
        pack(good | {"ttl_days": 0}), pack(good | {"ttl_days": 366}), pack(good | {"ttl_days": 1.5}), pack(good | {"ttl_days": True}), pack(good | {"memory_type": "task"}), pack(good | {"key": " "}), pack(good | {"more": 1}),
        pack({k: v for k, v in good.items() if k != "value"}), pack(*[good | {"key": str(i)} for i in range(6)]), pack(good, other=1), json.dumps([good]), "x" + pack(good), pack(good | {"key": "k" * 121}), pack(good | {"key": 3}), None, "",
    ]
    turns = spark.createDataFrame([(i, p, message) for i, p in enumerate(right + wrong)] + [(99, right[0], None), (98, right[0], "my cat is Tom " * 40), (97, pack(), message)], "i int, p string, m string")
    got = rows(personal.parse_personal(turns, "p", "m"), "i", "key", "value", "ttl_days", "evidence")
    assert got == [(0, "cat", "Tom", None, "my cat is Tom"), (1, "cat", "Tom", None, "my cat is Tom"), (2, "cat", "Tom", 365, "my cat is Tom"), (3, "cat", "Tom", None, "my cat is Tom"), (4, "茶", "Tom", None, "我喜欢茶")]


def test_first_person_and_sensitive(spark):
    assert column(spark, ["I am", "my dog", "me and my friend", "I know her", "mine", "himself", "我很好", "我的朋友", "it is", "MY THEIRS"], personal.is_first_person) == [True, True, True, False, True, False, True, False, False, True]
    assert column(spark, ["a Password", "我的密码", "diagnosis", "id-number", "id number", "idea", "银行卡号"], personal.is_sensitive) == [True, True, True, True, True, False, True]


def test_self_statements(spark):
    said = [
        "我是一名前端开发者，目前重点学习 XSS。", "我目前正在系统学习 数据库！我偏好先给结论", "我希望 回答时 用中文。我偏好简短", "我的同事是一名医生", "我是一名信用卡职员", "I am a nurse", None, "我偏好" + "长" * 498, "我希望明天好", "大家好，我的职业是 教师",
    ]
    got = rows(personal.extract_self_statements(spark.createDataFrame(list(enumerate(said)), "i int, m string"), "m"), "i", "memory_type", "key", "value", "confidence", "evidence")
    assert got == sorted(
        [
            (0, "profile", "职业背景", "前端开发者", 0.94, "我是一名前端开发者"), (0, "fact", "重点关注主题", "XSS", 0.93, "我是一名前端开发者，目前重点学习 XSS"), (1, "fact", "持续学习主题", "数据库", 0.93, "我目前正在系统学习 数据库"),
            (1, "preference", "回答方式", "先给结论", 0.95, "我偏好先给结论"), (2, "preference", "回答方式", "简短", 0.95, "我偏好简短"), (9, "profile", "职业背景", "教师", 0.94, "我的职业是 教师"),
        ],
        key=repr,
    )


def test_summaries(spark):
    fact = {"memory_type": "task", "key": "k", "value": "v"}
    turns = [(0, None, " hi  there ", "yes", [fact]), (1, "p" * 1200, "u", "a" * 500, None), (2, "p" * 1201, "u", "a", []), (3, " ", "u", "a" * 501, None), (4, None, " ", "a", None), (5, None, None, "a", None)]
    schema = "i int, prior string, user string, assistant string, facts array<struct<memory_type:string,key:string,value:string>>"
    got = dict(rows(personal.build_summary(spark.createDataFrame(turns, schema), "facts"), "i", "summary"))
    assert got == {0: "User: hi there\nAssistant: yes\nWorking memory: task:k=v", 1: ("Prior: " + "p" * 1200)[:1200], 2: "User: u\nAssistant: a", 3: None, 4: None, 5: None}
    facts = [{"memory_type": "t", "key": " ", "value": "x"}, *[fact | {"key": str(i)} for i in range(8)], {"memory_type": None, "key": "a", "value": "b"}]
    made = spark.createDataFrame([(" s ", facts), (None, None)], "s string, facts array<struct<memory_type:string,key:string,value:string>>")
    shown = made.select(personal.format_session_memory(F.col("s"), F.col("facts")), personal.format_personal_memories(F.col("facts"))).collect()
    assert tuple(shown[0]) == ("Summary: s\nWorking memory: " + "; ".join(f"task: {i}=v" for i in range(6)), "\n".join(f"task: {i}=v" for i in range(5))) and tuple(shown[1]) == ("", "")


# --- retrieval


def test_index_reads_the_asked_buckets_and_takes_appends(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    texts = [(i, " ".join(f"w{(i * 7 + j * j) % 40}" for j in range(i % 9))) for i in range(60)] + [(60, None)]
    chunks = spark.createDataFrame(texts, "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "w1 w2 w2"), (2, "W39 none"), (3, "")], "query_id long, text string")
    bm25_table.append_index(chunks.where("chunk_id < 40"), path, 0, 16)
    bm25_table.append_index(chunks.where("chunk_id >= 20"), path, 1, 16)  # half of it is there already
    want = rows(retrieval.bm25_topk(queries, chunks, 5), "query_id", "chunk_id", "bm25_score", "bm25_rank")
    got = lambda: rows(bm25_table.bm25_topk_indexed(queries, path, 5, 16), "query_id", "chunk_id", "bm25_score", "bm25_rank")
    assert got() == want and len(want) > 8
    asked = retrieval.asked_terms(queries)
    postings = bm25_table.indexed_postings(spark, path, asked, 16)
    plan = postings._jdf.queryExecution().executedPlan().toString()
    wanted = {str(r[0]) for r in asked.select(bm25_table._bucket(16)).distinct().collect()}
    read = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in read and set(read.split("IN (")[1].split(")")[0].split(",")) == wanted and len(wanted) <= 4
    bm25_table.append_index(chunks.where("chunk_id >= 20"), path, 1, 16)  # once more
    assert got() == want
    # A batch that stopped before its statistics doesn't count.
    spark.createDataFrame([(99, 3, "w1", 5)], "chunk_id long, dl int, term string, tf long").withColumn("bucket", bm25_table._bucket(16)).write.partitionBy("bucket").parquet(f"{path}/postings/batch=2")
    assert got() == want


def test_search_legs_shuffle_no_tokens(spark):
    import math
    import re

    texts = ["a b a", "", None, "B_c  b\tc", "É é x1", "zz", "a b a", *[" ".join(f"w{(i * j) % 23}" for j in range(i % 11)) for i in range(1200)]]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    queries = spark.createDataFrame([(0, "A b"), (1, "é w3 w5 w5"), (2, None), (3, "none at all"), (4, "w0")], "query_id long, text string")
    split = [[w for w in re.split(r"[\W_]+", (t or "").lower()) if w] for t in texts]
    mean, want = sum(map(len, split)) / len(split), []
    for q, asked in enumerate([{"a", "b"}, {"é", "w3", "w5"}, set(), {"none", "at", "all"}, {"w0"}]):
        idf = {w: math.log(1 + (len(split) - n + 0.5) / (n + 0.5)) for w in asked if (n := sum(w in s for s in split))}
        scores = [(i, round(sum(v * s.count(w) * 2.2 / (s.count(w) + 1.2 * (0.25 + 0.75 * len(s) / mean)) for w, v in idf.items()), 6)) for i, s in enumerate(split) if set(s) & asked]
        want += [(q, i, s, r + 1) for r, (i, s) in enumerate(sorted(scores, key=lambda x: (-x[1], x[0]))[:20])]
    got = retrieval.bm25_topk(queries, chunks)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 40
    for made in (retrieval.hash_embed(chunks, "chunk_id"), retrieval.hash_embed_small(chunks, "chunk_id")):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert "chunk_id" not in " ".join(re.findall(r"Exchange hashpartitioning\((.*?)\)", got._jdf.queryExecution().executedPlan().toString()))


def test_containing_against_all_pairs_without_shuffle(spark):
    long = "one two three four five six seven eight nine"
    texts = [f"x{long}y z", long, f"{long} {long}", long.replace("six", "sex"), "one  two", None, "", "one two three four", *[f"{i} {long}" for i in range(1100)]]
    items = [long, long[1:-1], "two", "", None, "four five", "one two three four five six seven nine", "a b c d e f g h"]
    found = evaluation.containing(spark.createDataFrame(list(enumerate(items)), "query_id long, text string"), spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string"))
    assert sorted(tuple(r) for r in found.collect()) == sorted((q, c) for q, a in enumerate(items) for c, t in enumerate(texts) if a is not None and t is not None and a in t)
    assert "Exchange hash" not in found._jdf.queryExecution().executedPlan().toString()


def test_dense_search_against_all_pairs(spark):
    import numpy as np

    r = np.random.default_rng(5)
    x = np.round(r.normal(size=(1500, 6)), 1)
    vectors = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(5000, None), (5001, [0.0] * 6)], "chunk_id long, embedding array<double>")
    queries = vectors.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    got = {}
    for row in retrieval.dense_topk(queries, vectors, 7).collect():
        got.setdefault(row.query_id, []).append((row.dense_rank, row.chunk_id, row.dense_score))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 1500, 100):
        s = np.round(unit @ unit[i], 9)
        best = sorted(range(1500), key=lambda j: (-s[j], j))[:7]
        assert [c for _, c, _ in sorted(got[i])] == best
    assert 5000 not in got


def test_percentiles_by_nearest_rank(spark):
    import math
    import random

    from kbspark.operators import evaluation

    rng = random.Random(3)
    rows = [(g, rng.choice([None, *range(40)]) if g else None) for g in (0, 1, 1, 1, 2, 2, 3, None) for _ in range(rng.randint(1, 60))]
    got = evaluation.percentile_nearest_rank(spark.createDataFrame(rows, "g int, v int"), ["g"], "v").collect()
    assert {r.g for r in got} == {g for g, _ in rows}
    for r in got:
        values = sorted(v for g, v in rows if g == r.g and v is not None)
        want = [values[max(1, math.ceil(p * len(values) - 1e-9)) - 1] if values else None for p in (0.5, 0.95, 0.99)]
        assert (r.n, [r.p50, r.p95, r.p99]) == (sum(g == r.g for g, _ in rows), want)
    assert evaluation.percentile_nearest_rank(spark.createDataFrame([], "g int, v int"), ["g"], "v").count() == 0


def test_split_parts_come_in_small_batches():
    import pyarrow as pa

    texts = [f"{i} " + "word " * 40 if i % 9 else None for i in range(2000)]
    made = list(chunking._parts(100, 0)([pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(texts)], ["doc_id", "text"])]))
    want = [(i, n, p) for i, t in enumerate(texts) if t for n, p in enumerate(chunking.split_text(t, 100, 0))]
    assert [tuple(r.values()) for batch in made for r in batch.to_pylist()] == want
    assert max(len(set(batch.column(0).to_pylist())) for batch in made) <= 256
