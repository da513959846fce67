"""Edge rows, with results worked out by hand."""

import json

from pyspark.sql import functions as F

from kbspark.functions import pages as P
from kbspark.functions import questions as Q
from kbspark.functions import text as T
from kbspark.operators import conversation, corpus, evaluation, memory, retrieval
from kbspark.sources import files


def column(spark, values, use, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", use(F.col("v")).alias("out")).orderBy("i").collect()]


def test_questions(spark):
    assert column(spark, ["", "怎么处理", "报销怎么处理", "要求", "What is it?"], Q.is_vague) == [True, True, False, True, False]
    assert column(spark, ["继续说", "what about it", "thenar", "the former plan", "plan"], Q.is_follow_up) == [True, True, False, True, False]
    assert column(spark, ["a vs. b", "with a or b", "troubleshooting order", "当空时", "a and b"], Q.is_complex) == [True, True, True, True, False]
    assert column(spark, ["abc", "a书"], Q.prefers_chinese) == [False, True]
    given = [" plain query ", "x", "a\nb", "- item", "Answer: x", '{"a": 1}', "12", "y" * 241, None]
    assert column(spark, given, Q.valid_rewrite) == ["plain query", *[None] * 8]
    assert column(spark, ["What, (Is) the is ORDER? a", ""], Q.keywords) == [["Is", "ORDER"], []]
    assert column(spark, ["the exact  first step now", "exact"], Q.strip_weak_terms) == ["the now", "exact"]


def test_pages(spark):
    assert column(spark, ["", None, "ab ab", "aab�"], lambda c: P.garbled_score(P.page_text(c))) == [1.0, 1.0, 0.0, 0.5]
    assert column(spark, ["", "aab", "   b"], lambda c: P.repeat_score(P.page_text(c))) == [0.0, 2 / 3, 1.0]
    assert column(spark, ["", "x = 1", "abcdefgh≤ "], lambda c: P.math_score(P.page_text(c))) == [0.0, 1.0, 0.1111]
    table = "### T\n\n| a |\n| - |\n| 1 |\n\n| 22 |\n| 3 |"
    assert column(spark, [table, "no table", "| a |"], P.table_rows) == [["### T\n\n| a |\n| - |\n" + r for r in ("| 1 |", "| 22 |", "| 3 |")], [], []]
    assert column(spark, [table, "no table", "| a |\n| - |", ""], lambda c: P.table_parts(c, 31)) == [
        ["### T\n\n| a |\n| - |\n| 1 |\n| 22 |", "### T\n\n| a |\n| - |\n| 3 |"], ["no table"], ["| a |\n| - |"], [""]
    ]
    made = P.markdown_table(F.lit("T"), F.col("v"), F.array(F.array(F.lit("x|y")), F.array(F.lit("1"), F.lit("a\nb"), F.lit("c"))))
    assert column(spark, [["h", "k"], []], lambda _: made, "array<string>") == ["### T\n\n| h | k |\n| --- | --- |\n| x\\|y |  |\n| 1 | a<br>b |", "### T"]


def test_prior_turns(spark):
    turns = [(1, 0, "assistant", "hello"), (1, 1, "user", "a"), (1, 2, "assistant", " "), (1, 3, "assistant", "x" * 900), (1, 4, "user", ""), (1, 5, "user", " a "), (1, 6, "user", "b"), (1, 7, "user", None)]
    rows = conversation.prior_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).orderBy("turn").collect()
    assert [(r.turn, r.prior_user, r.prior_answer) for r in rows] == [(1, None, None), (4, "a", "x" * 800), (5, None, None), (6, "a", None), (7, "b", None)]


def test_memory_facts(spark):
    fact = lambda k, v="v", c=0.5: {"key": k, "value": v, "confidence": c}
    make = lambda *task, **more: json.dumps({"task": list(task), "constraint": [], "entity": [], "open_question": []} | more)
    right = make(fact("A"), fact("a", "w"), fact("b", c=1))
    wrong = [
        make(fact("k", c=1.1)), make(fact("k", c=True)), make(fact("k", c="0.5")), make(fact(" ")), make(fact("k" * 121)), make(*[fact(str(i)) for i in range(5)]), make(fact(3)),
        make({"key": "k", "value": "v"}, fact("j")), make(fact("k"), other=[]), make(entity={}), "[]", "", "{", None,
    ]
    turns = spark.createDataFrame(list(enumerate([right, *wrong])), "i int, p string")
    got = memory.parse_facts(turns, "p").collect()
    assert [(r.i, r.memory_type, r.key, r.value, r.confidence) for r in got] == [(0, "task", "A", "v", 0.5), (0, "task", "b", "v", 1.0)]


def test_rerank_and_union(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1), (2, 11, 2)], "query_id int, chunk_id int, rank int")
    scores = spark.createDataFrame([(1, 12, 0.9), (1, 11, 0.1)], "query_id int, chunk_id int, rerank_score double")
    got = {(r.query_id, r.chunk_id, r.rerank_rank) for r in retrieval.apply_rerank(hits, scores, 2).collect()}
    assert got == {(1, 12, 1), (1, 11, 2), (2, 10, None), (2, 11, None)}
    legs = hits.select(F.lit(7).alias("query_id"), F.col("query_id").alias("leg"), "chunk_id", "rank")
    assert {(r.leg, r.chunk_id, r.place) for r in retrieval.multi_query_union(legs).collect()} == {(1, 10, 1), (1, 11, 2), (1, 12, 3)}


def test_gates(spark):
    report = lambda *v: spark.createDataFrame([v], "recall double, mrr double, llm_call_rate double, p95_ms double")
    assert evaluation.compare_reports(report(0.9, 0.8, 0.0, 10.0), report(0.9, 0.8, 0.3, 1510.0)).first().passed
    assert evaluation.compare_reports(report(0.9, 0.8, 0.0, 10.0), report(0.8, 0.7, 0.4, 1511.0)).first().failed_gates == "recall,MRR,llm_call_rate,P95_ms"


def test_memo(spark):
    asked = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "digest string, revision int")
    memo = spark.sql("SELECT * FROM VALUES ('a', 1, timestamp'2024-01-01 00:00:10', 'x'), ('b', 1, timestamp'2024-01-01 00:00:00', 'y'), ('c', 1, timestamp'2024-01-01 00:00:10', 'z') AS t(digest, revision, created_at, result)")
    found, missed = corpus.memo_join(asked, memo, "2024-01-01 00:00:15", 10)
    assert [r.result for r in found.collect()] == ["x"] and {r.digest for r in missed.collect()} == {"b", "c"}


def test_files(spark, tmp_path):
    for name, raw in {"01_guide/a.MD": b"x", "01_guide/tmp/b.md": b"x", "c.txt": "书".encode("gb18030"), "d.exe": b"", "p.png": b"\xff\xff\xff"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    got = files.discover_files(spark, str(tmp_path)).withColumn("text", files.decode_text(F.col("content"))).collect()
    assert {(r.relative, r.file_type, r.scenario, r.text) for r in got} == {("01_guide/a.MD", "md", "guide", "x"), ("c.txt", "txt", "c.txt", "书"), ("p.png", "png", "p.png", "�" * 3)}
    assert {r.relative for r in files.discover_files(spark, str(tmp_path), images=False).collect()} == {"01_guide/a.MD", "c.txt"}
    (tmp_path / "r.jsonl").write_text('{"id": "1", "n": 1}\n\n{"id": "1", "n": 2}\n{"n": 3}\n')
    assert [(r.id, r.n) for r in files.load_answer_records(spark, str(tmp_path / "r.jsonl"), "id string, n int").collect()] == [("1", 2)]


def test_trigrams(spark):
    rows = [("abcd", "xabcdx"), ("abcd", "abc"), ("ab", "xx"), ("", "x"), ("aaaa", "aaa"), ("a书b", "a书c"), ("abc", None)]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, e string, a string")
    assert [r.out for r in got.select("i", T.ngram_recall(F.col("e"), F.col("a")).alias("out")).orderBy("i").collect()][:6] == [1.0, 0.5, 0.0, 1.0, 1.0, 0.0]


def test_whitespace_trims_only_spaces(spark):
    """Digits at the ends of lines stay, whatever the number of the line."""
    from pyspark.sql import functions as F

    from kbspark.functions import text as T

    row = spark.range(1).select(T.normalize_whitespace(F.lit("0 a \n 1 b 1\n2")).alias("t"), T.filled_lines(F.lit("0 a \n 1 b 1\n2")).alias("l")).first()
    assert row.t == "0 a\n1 b 1\n2" and row.l == ["0 a", "1 b 1", "2"]


def test_split_text_by_separators():
    from kbspark.operators.chunking import split_text

    assert split_text("aaa bbb ccc", 7, 3) == ["aaa", "bbb", "ccc"] or split_text("aaa bbb ccc", 7, 3) == ["aaa bbb", "ccc"]
    text = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(60)) for i in range(6))
    parts = split_text(text, 200, 40)
    assert all(len(p) <= 200 for p in parts) and {w for p in parts for w in p.split()} == set(text.split())
    assert split_text("x" * 500, 200, 40) == ["x" * 200, "x" * 200, "x" * 180] and split_text("  ", 10, 2) == []


def test_heading_blocks(spark):
    """A stack cut by its length: a level-2 heading after levels 1 and 3 keeps the first alone."""
    from kbspark.operators.chunking import build_chunks, heading_blocks

    text = "intro\n# A\na\n### C #\nc\n## B\n\n## D\nd"
    rows = [(1, text), (2, "plain\r\ntext "), (3, "# only"), (4, None), (5, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.section): r.text for r in heading_blocks(docs).collect()}
    assert got == {
        (1, None): "intro", (1, "A"): "# A\na", (1, "A / C"): "# A\n\n### C #\nc", (1, "A / D"): "# A\n\n## D\nd",
        (2, None): "plain\ntext", (3, "only"): "# only",
    }
    chunks = build_chunks(docs.union(spark.createDataFrame([(6, "one two. " * 300)], "doc_id long, text string"))).collect()
    assert {r.doc_id for r in chunks} == {1, 2, 6} and all(len(r.text) <= 900 for r in chunks)
    assert sorted(r.chunk_index for r in chunks if r.doc_id == 6) == list(range(sum(r.doc_id == 6 for r in chunks)))


def test_next_snapshot_keeps_what_is_outside(spark):
    from kbspark.operators import corpus

    old = spark.createDataFrame([("", "root", "h0"), ("a", "root", "h1"), ("b", "root", "h2"), ("c", "other", "h3"), (None, None, "h4")], "source_key string, source_root string, file_hash string")
    new = spark.createDataFrame([("a", "root", "h1"), ("c", "root", "h9")], "source_key string, source_root string, file_hash string")
    diff = corpus.diff_snapshot(old.where("source_root = 'root'"), new)
    assert sorted(r.file_hash for r in corpus.next_snapshot(old, new, diff, "root").collect()) == ["h0", "h1", "h3", "h4", "h9"]


def test_normalize_for_dedup_folds_compatibility_forms(spark):
    from pyspark.sql import functions as F

    from kbspark.functions import text as T

    rows = spark.createDataFrame([("ＡＢ ﬁ\u3000Straße",), ("Plain  Text",), (None,)], "t string").select(T.normalize_for_dedup(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == ["ab fi strasse", "plain text", None]


def test_ngram_candidates_are_all_pairs(spark):
    """Every item meets every chunk that shares enough trigrams, whatever the ids."""
    from kbspark.operators import evaluation

    items = [(1, "press forming"), (2, "ab"), (3, None), (4, "aaaa")]
    chunks = [(7, "the press forms"), (12, "aaa"), (13, ""), (14, None), (15, "press forming of steel")]
    grams = lambda t: {t[i : i + 3] for i in range(len(t or "") - 2)}
    want = {(i, d): len(grams(e) & grams(t)) / len(grams(e)) for i, e in items for d, t in chunks if grams(e)}
    got = evaluation.ngram_candidates(spark.createDataFrame(items, "item_id int, expected string"), spark.createDataFrame(chunks, "doc_id int, text string"))
    assert {(r.item_id, r.doc_id): r.recall for r in got.collect()} == {k: v for k, v in want.items() if v >= 0.35}


def test_activate_version_keeps_to_its_base(spark):
    rows = [("k", "v1", "active"), ("k", "v2", "ready"), ("k", "v3", "failed"), ("other", "v1", "active"), (None, "v2", "active")]
    versions = spark.createDataFrame(rows, "kb_id string, version string, status string")
    status = lambda df: [r.status for r in df.orderBy(F.col("kb_id").asc_nulls_last(), "version").collect()]
    assert status(corpus.activate_version(versions, "v2", "k")) == ["superseded", "active", "failed", "active", "active"]
    assert status(corpus.activate_version(versions.where("kb_id = 'k'"), "v2")) == ["superseded", "active", "failed"]


def test_document_groups(spark):
    rows = [("r", "a", "h1"), ("r", "a", "h1"), ("s", "a", "h2"), (None, "a", "h3"), (None, "a", None)]
    got = corpus.document_groups(spark.createDataFrame(rows, "source_root string, source_key string, file_hash string")).collect()
    assert {(r.source_root, r.source_key, r.file_hash, r.n_chunks) for r in got} == {("r", "a", "h1", 2), ("s", "a", "h2", 1), (None, "a", "h3", 2)}


def test_snapshot_revision_tells_rows_but_not_their_order(spark):
    rows = [(1, "a"), (2, "b"), (2, "b"), (3, None), (4, "")]

    def revision(rows):
        return corpus.snapshot_revision(spark.createDataFrame(rows, "id int, text string"), ["id", "text"]).first().revision

    same = revision(rows)
    assert revision(rows[::-1]) == same
    others = [rows[:2] + rows[3:], rows[:3] + [(3, ""), (4, None)], rows[1:], [(1, "b"), (2, "a"), *rows[2:]], []]
    assert len({same, *map(revision, others)}) == 1 + len(others)


def test_join_wrapped_lines(spark):
    values = ["one\ntwo\n\nthree\n\n\nfour\nfive", "", None, "alone"]
    assert column(spark, values, T.join_wrapped_lines) == ["one two\n\nthree\n\nfour five", "", None, "alone"]


def test_ngram_candidates_shuffle_no_row_for_each_gram(spark):
    """Runs of any length, characters beyond 16 bits and more texts than a pack, against plain sets; nothing explodes."""
    from kbspark.operators import evaluation

    items, chunks = [(1, "ab\U0001f600cdé"), (2, "xyzxyz"), (3, None), (4, "ab")], [(i, ["ab\U0001f600c", "zxyzx", None, "a", "b\U0001f600cd" * 3][i % 5]) for i in range(1500)]
    for n in (1, 3, 4, 5):
        made = evaluation.ngram_candidates(spark.createDataFrame(items, "item_id int, expected string"), spark.createDataFrame(chunks, "doc_id int, text string"), 0.2, n)
        assert "Generate" not in made._jdf.queryExecution().toString()
        runs = lambda t: {t[i : i + n] for i in range(len(t or "") - n + 1)}  # noqa: B023, E731
        want = {(i, d): len(runs(e) & runs(t)) / len(runs(e)) for i, e in items if runs(e) for d, t in chunks if len(runs(e) & runs(t)) >= 0.2 * len(runs(e))}
        assert {(r.item_id, r.doc_id): r.recall for r in made.collect()} == want


def test_heading_blocks_are_made_once(spark):
    """Lines are numbered and grouped once, for blocks with headings and texts without a block alike."""
    from kbspark.operators.chunking import heading_blocks

    docs = spark.createDataFrame([(1, "# a\nb"), (2, "# bare"), (3, " "), (4, None)], "doc_id long, text string")
    made = heading_blocks(docs)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    assert sorted(tuple(r) for r in made.collect()) == [(1, 1, "a", "# a\nb"), (2, 0, "bare", "# bare")]
