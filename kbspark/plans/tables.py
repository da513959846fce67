"""Registered queries on tables in files and pages, question sets and sinks, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import personal
from ..sources import question_sets, sinks, tables
from ..streaming.history import _shared
from .queries import _t, query

_LINKS = r"""ln AS (SELECT page_id, list_transform(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1), lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS ls FROM pages)"""


@query(rf"""WITH {_LINKS}, r AS (SELECT page_id, i, CASE WHEN i % 3 = 0 THEN [(i // 3)::VARCHAR, ls[i + 1], ls[i + 1]] WHEN i % 3 = 1 THEN [(i // 3)::VARCHAR, ls[i + 1], 'x & y'] ELSE [(i // 3)::VARCHAR, ls[i + 1], ''] END AS line
  FROM ln, unnest(range(len(ls))) t(i)),
 g AS (SELECT page_id, list_concat([['Links of ' || page_id, 'Links of ' || page_id, 'Links of ' || page_id], ['n', 'name', 'more']], list(line ORDER BY i)) AS grid FROM r GROUP BY 1)
 SELECT page_id, 'Links of ' || page_id AS title, 'n|name|more' AS headers, len(grid) - 2 AS n_rows, md5(array_to_string(list_transform(grid, lambda l: array_to_string(l, '|')), chr(10))) AS grid_md5 FROM g""")
def html_tables(spark, sf_dir):
    """The links of each page as a table: a title over all columns, cells over two columns and over three rows, references."""
    links = F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1))
    cell = lambda x, i: F.concat(
        F.lit("<TR class='a>b'>"), F.when(i % 3 == 0, F.concat(F.lit("<td rowspan=3>"), (i / 3).cast("long").cast("string"), F.lit("</td>"))).otherwise(""),
        F.when(i % 3 == 0, F.concat(F.lit("<td colspan='2'><b>"), x, F.lit("</b></td>"))).when(i % 3 == 1, F.concat(F.lit("<td> "), x, F.lit("</td><td data-x='>'>x &amp;\n y</td>"))).otherwise(F.concat(F.lit("<td>"), x, F.lit("</td><td></td>"))), F.lit("</TR>\n"),
    )
    head = F.concat(F.lit('<p>before</p><table><tr></tr><tr><th colspan="3">Links of '), F.col("page_id").cast("string"), F.lit("</th></tr><tr><th>n</th><th>name</th><th>more</th></tr>"))
    made = _t(spark, sf_dir, "pages").where(F.size(links) > 0).select("page_id", F.concat(head, F.array_join(F.transform(links, cell), ""), F.lit("</table>")).alias("html"))
    grid = F.array_join(F.transform("grid", lambda row: F.array_join(row, "|")), "\n")
    return tables.html_tables(made).select("page_id", "title", F.array_join("headers", "|").alias("headers"), F.size("rows").cast("long").alias("n_rows"), F.md5(grid.cast("binary")).alias("grid_md5"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents)
 SELECT doc_id, 'lines ' || doc_id AS title, len(ls) AS n_rows, md5('### lines ' || doc_id || chr(10) || chr(10) || '| n | line |' || chr(10) || '| --- | --- |' || CASE WHEN len(ls) > 0 THEN chr(10) ELSE '' END
  || array_to_string(list_transform(ls, lambda x, i: '| ' || i || ' | ' || replace(x, '|', '\|') || ' |'), chr(10))) AS markdown_md5 FROM l""")
def delimited_table(spark, sf_dir):
    """Every document as a file of tab-delimited lines: numbered, quoted, with empty rows between."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    quoted = F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit('\t" '), F.replace(x, F.lit('"'), F.lit('""')), F.lit(' "\n\t \n')))
    files = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/in/lines "), F.col("doc_id").cast("string"), F.lit(".tsv")).alias("path"), F.concat(F.lit("\nn\tline\n"), F.array_join(quoted, "")).alias("text"))
    made = tables.delimited_table(files, "\t")
    return made.select("doc_id", "title", F.size("rows").cast("long").alias("n_rows"), F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"))


@query(r"""WITH q AS (SELECT item_id, trim(regexp_replace(substr(text, 1, 80), '\s+', ' ', 'g')) AS t FROM benchmark)
 SELECT item_id % 3 AS kind, 'TQ-' || item_id AS id, 'doc ' || item_id % 7 AS document, CASE WHEN item_id % 3 = 0 THEN '' ELSE 'k' END AS keyword, t AS question, CASE WHEN item_id % 3 = 2 THEN 'last: one' ELSE 'e' END AS expected,
 CASE WHEN item_id % 6 = 1 THEN 'c1' ELSE '' END AS expected_chunk_id, CASE WHEN item_id % 3 = 2 THEN 'a;b' ELSE '' END AS expected_chunk_ids,
 CASE WHEN item_id % 3 = 1 THEN 0 WHEN item_id % 2 = 0 THEN 2 ELSE 0 END AS messages, CASE WHEN item_id % 3 <> 1 AND item_id % 2 = 1 THEN CASE WHEN item_id % 5 = 0 THEN 'invalid History JSON' WHEN item_id % 5 < 3 THEN 'History JSON must be a list' ELSE 'History JSON items require string role and content' END END AS error FROM q""")
def question_sets_parsed(spark, sf_dir):
    """The benchmark as files of three formats, by item_id: a file with a header, a table row, a block; half of the histories are wrong."""
    i, key = F.col("item_id"), F.col("item_id").cast("string")
    text = F.trim(F.regexp_replace(F.substring("text", 1, 80), r"\s+", " "))
    wrong = F.when(i % 5 == 0, '[{"role"').when(i % 5 < 3, '{"role": "user", "content": "a"}').otherwise('[{"role": "user", "content": "a"}, {"role": "user", "content": 3}]')
    history = F.when(i % 2 == 0, '[{"role": "user", "content": "a, b"}, {"content": "c", "role": "assistant", "more": 1}]').otherwise(wrong)
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    doc = F.concat(F.lit("doc "), (i % 7).cast("string"))
    file = F.concat(F.lit("﻿id,document,question,expected,history,other\n"), F.lit("TQ-"), key, F.lit(", "), doc, F.lit(" ,"), quoted(text), F.lit(",e,"), quoted(history), F.lit(",z\n"))
    row = F.concat(F.lit("# Set\n| id | d |\n| TQ-short | x |\n| TQ-"), key, F.lit(" | "), doc, F.lit(" | k | "), text, F.lit(" | e |"), F.when(i % 6 == 1, " c1 |").otherwise(""), F.lit("\n"))
    block = F.concat(
        F.lit("Question: none yet\r\n## TQ-"), key, F.lit(" \r\nDocument: "), doc, F.lit("\r\n Keyword :k\r\nExpected: first\nQuestion: "), text, F.lit("\nExpected: last: one\nExpected Chunk IDs: a;b\nOther: x\nHistory JSON: "), history,
        F.lit("\n## no question\nKeyword: k\n## \nQuestion: no id"),
    )
    files = _t(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("sets/"), key, F.when(i % 3 == 0, ".CSV").otherwise(".md")).alias("path"), F.when(i % 3 == 0, file).when(i % 3 == 1, row).otherwise(block).alias("text")
    )
    return question_sets.parse_question_set(files).select(
        F.col("kind").cast("long").alias("kind"), "id", "document", "keyword", "question", "expected", "expected_chunk_id", "expected_chunk_ids", F.size("history").alias("messages"), "error"
    )


@query("""SELECT source, count(*) AS rows, sum(CASE WHEN source = (SELECT min(source) FROM documents) THEN 1 ELSE n_chars END)::BIGINT AS chars FROM documents GROUP BY 1""")
def replaced_partitions(spark, sf_dir):
    """A table by source, of which the partition of the least source is written anew."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    path = f"{_shared(spark)}/replaced-{uuid.uuid4().hex}"
    sinks.replace_partitions(docs, path, ["source"])
    least = docs.agg(F.min("source").alias("source"))
    sinks.replace_partitions(docs.join(F.broadcast(least), "source").withColumn("n_chars", F.lit(1).cast("long")).select("doc_id", "n_chars", "source"), path, ["source"])
    return spark.read.schema(docs.schema).parquet(path).groupBy("source").agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars"))


# Statements: the writer's word for a text of one language, of others, of secrets; payloads break a rule by conv_id.
_SAID = r"""st AS (SELECT conv_id, turn, trim(regexp_replace(substr(text, 1, 40), '\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'user' AND trim(substr(text, 1, 40)) <> '')"""


@query(rf"""WITH {_SAID}, k AS (SELECT *, t AS key FROM st WHERE conv_id % 8 IN (0, 1) AND NOT regexp_matches(t, '(?i)password|passwd|token|secret|credential|phone|telephone|email|contact|passport|id[ _-]?number|health|medical|diagnos|bank|card number|credit card|income')
  AND NOT regexp_matches(regexp_replace(t, '[^\x00-\x7F]', '_', 'g'), '(?i)\b(?:he|she|they|their|his|her)\b'))
 SELECT conv_id, turn, 'fact' AS memory_type, key, 'v ' || turn AS value, 0.5::DOUBLE AS confidence, CASE WHEN conv_id % 2 = 0 THEN 30 END AS ttl_days, 'my ' || t AS evidence FROM k UNION ALL
 SELECT conv_id, turn, 'profile', 'role', 'b', 1.0, NULL, 'I like' FROM k""")
def personal_memories(spark, sf_dir):
    """Payloads of one conversation in four are right, half of them in a code fence; each other kind breaks one rule."""
    kind = F.col("conv_id") % 8
    turns = _t(spark, sf_dir, "conversations").where("role = 'user' AND trim(substr(text, 1, 40)) <> ''").withColumn("t", F.trim(F.regexp_replace(F.substring("text", 1, 40), r"\s+", " ")))
    message = F.concat(F.lit("  my\n"), "t", F.lit(" and I  like it"))
    entry = lambda *fields: F.to_json(F.struct(*fields))
    first = entry(
        F.lit("fact").alias("memory_type"), F.col("t").alias("key"), F.concat(F.lit(" v  "), F.col("turn").cast("string")).alias("value"), F.when(kind == 2, 1.5).otherwise(0.5).alias("confidence"),
        F.when(kind == 3, F.lit("you say")).otherwise(F.concat(F.lit("my "), "t")).alias("evidence"), F.when(kind % 2 == 0, F.when(kind == 4, 400).otherwise(30)).alias("ttl_days"),
    )
    second = entry(F.lit("profile").alias("memory_type"), F.lit("role").alias("key"), F.when(kind == 5, "my secret").otherwise("b").alias("value"), F.lit(1).alias("confidence"), F.lit("I like").alias("evidence"), F.when(kind == 6, "x").alias("other"))
    again = F.replace(second, F.lit('"role"'), F.lit('"ROLE"'))
    body = F.concat(F.lit('{"memories": ['), first, F.lit(", "), second, F.lit(", "), again, F.when(kind == 7, "], \"n\": [").otherwise(""), F.lit("]}"))
    payload = F.when(kind == 1, F.concat(F.lit("```JSON\n"), body, F.lit("\n```\n"))).otherwise(body)
    return personal.parse_personal(turns.select("conv_id", "turn", payload.alias("p"), message.alias("m")), "p", "m").drop("p", "m")


_RULE_SQL = [
    ("profile", "职业背景", 0.94, "(我(?:目前)?(?:是一名|是一个|是|的职业是)\\s*([^，。；！？!?]{2,40}))"), ("fact", "持续学习主题", 0.93, "(我(?:目前)?(?:正在)?(?:系统)?学习\\s*([^，。；！？!?]{1,80}))"),
    ("fact", "重点关注主题", 0.93, "(我[^。；！？!?]{0,100}?(?:目前)?重点(?:学习|关注)\\s*([^，。；！？!?]{1,80}))"), ("preference", "回答方式", 0.95, "(我偏好\\s*([^。；！？!?]{2,160}))"),
]


@query(rf"""WITH st AS (SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN '我目前是一名' WHEN 1 THEN '我目前正在学习 ' WHEN 2 THEN '我最近重点关注' WHEN 3 THEN '我偏好' ELSE '我的同事是' END || trim(regexp_replace(regexp_replace(substr(text, 1, 30), '[!?]', '', 'g'), '\s+', ' ', 'g')) || '！好' AS t FROM conversations
  WHERE role = 'user' AND length(trim(regexp_replace(regexp_replace(substr(text, 1, 30), '[!?]', '', 'g'), '\s+', ' ', 'g'))) >= 2),
 f AS ({" UNION ALL ".join(f"SELECT conv_id, turn, '{kind}' AS memory_type, '{key}' AS key, {sure}::DOUBLE AS confidence, trim(regexp_extract(t, '{rule}', 1)) AS evidence, trim(regexp_extract(t, '{rule}', 2)) AS value FROM st" for kind, key, sure, rule in _RULE_SQL)})
 SELECT conv_id, turn, memory_type, key, value, confidence, evidence FROM f WHERE value <> '' AND NOT contains(evidence, '同事') AND NOT regexp_matches(regexp_replace(evidence, '[^\x00-\x7F]', '_', 'g'), '(?i)\b(?:he|she|they|their|his|her)\b')
  AND NOT regexp_matches(evidence, '(?i)password|passwd|token|secret|credential|phone|telephone|email|contact|passport|id[ _-]?number|health|medical|diagnos|bank|card number|credit card|income')""")
def self_statements(spark, sf_dir):
    """Each user message, cut, as a statement of one of five kinds, the last of which speaks of another."""
    said = F.trim(F.regexp_replace(F.regexp_replace(F.substring("text", 1, 30), "[!?]", ""), r"\s+", " "))
    start = F.element_at(F.array(*[F.lit(x) for x in ("我目前是一名", "我目前正在学习 ", "我最近重点关注", "我偏好", "我的同事是")]), (F.col("conv_id") % 5 + 1).cast("int"))
    turns = _t(spark, sf_dir, "conversations").where((F.col("role") == "user") & (F.length(said) >= 2)).select("conv_id", "turn", F.concat(start, said, F.lit("！好")).alias("m"))
    return personal.extract_self_statements(turns, "m").drop("m")


@query(r"""WITH u AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS u FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn - 1 AS turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS a FROM conversations WHERE role = 'assistant'),
 b AS (SELECT conv_id, turn, u, trim(substr(a, 1, 400)) AS a, CASE WHEN turn > 0 THEN repeat('prior ', conv_id::INT % 250) END AS p, conv_id % 3 AS k FROM u JOIN a USING (conv_id, turn)),
 s AS (SELECT *, trim(p) AS q, CASE WHEN k > 0 THEN chr(10) || 'Working memory: task:a=1' || CASE WHEN k > 1 THEN '; entity:b=2' ELSE '' END ELSE '' END AS m FROM b)
 SELECT conv_id, turn, CASE WHEN length(u) BETWEEN 1 AND 500 AND length(a) > 0 THEN md5(substr(CASE WHEN length(q) BETWEEN 1 AND 1200 THEN 'Prior: ' || q || chr(10) ELSE '' END || 'User: ' || u || chr(10) || 'Assistant: ' || a || m, 1, 1200)) END AS summary_md5,
 md5('Summary: s' || replace(replace(m, 'task:', 'task: '), 'entity:', 'entity: ')) AS session_md5, array_to_string((['task: a=1', 'entity: b=2'])[1:k], chr(10)) AS personal FROM s""")
def turn_summaries(spark, sf_dir):
    """Summaries of questions and the answers that follow them, and memory as a prompt has it."""
    turns, n = _t(spark, sf_dir, "conversations"), F.col("conv_id") % 3
    flat = lambda role: turns.where(F.col("role") == role).select("conv_id", "turn", F.trim(F.regexp_replace("text", r"\s+", " ")).alias(role))
    both = flat("user").join(flat("assistant").withColumn("turn", F.col("turn") - 1), ["conv_id", "turn"]).withColumn("assistant", F.substring("assistant", 1, 400))
    fact = lambda kind, key, value: F.struct(F.lit(kind).alias("memory_type"), F.lit(key).alias("key"), F.lit(value).alias("value"))
    facts = F.slice(F.array(fact("task", "a", "1"), fact("entity", "b", "2")), 1, n.cast("int"))
    both = both.withColumns({"prior": F.when(F.col("turn") > 0, F.repeat(F.lit("prior "), (F.col("conv_id") % 250).cast("int"))), "facts": facts})
    shown = F.concat(F.array(fact("task", " ", "x")), F.col("facts"))
    made = personal.build_summary(both, "facts")
    return made.select(
        "conv_id", "turn", F.md5(F.col("summary").cast("binary")).alias("summary_md5"), F.md5(personal.format_session_memory(F.lit(" s "), shown).cast("binary")).alias("session_md5"),
        personal.format_personal_memories(shown).alias("personal"),
    )
