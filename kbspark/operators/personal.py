"""What users say of themselves, and memory as text for a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, let

# Types and limits of personal memories, words of the first person, of others and of sensitive matters, and the rules.
TYPES = ("preference", "profile", "fact")
MOST, KEY_CHARS, VALUE_CHARS, TTL_DAYS = 5, 120, 500, 365
FIRST_PERSON = r"(?iU)\b(?:i|me|my|mine)\b|我|本人"
OTHERS = r"(?iU)\b(?:he|she|they|their|his|her)\b|他|她|它|他们|她们|朋友|家人|同事"
SENSITIVE = (
    r"(?iu)password|passwd|token|secret|credential|密码|密钥|令牌|phone|telephone|email|contact|手机号|电话|邮箱|联系方式|passport|id[ _-]?number|身份证|护照|health|medical|diagnos|病历|健康|诊断"
    r"|bank|card number|credit card|income|财务|银行卡|信用卡|收入"
)
RULES = (
    ("profile", "职业背景", 0.94, r"(我(?:目前)?(?:是一名|是一个|是|的职业是)\s*([^，。；！？!?]{2,40}))"),
    ("fact", "持续学习主题", 0.93, r"(我(?:目前)?(?:正在)?(?:系统)?学习\s*([^，。；！？!?]{1,80}))"),
    ("fact", "重点关注主题", 0.93, r"(我[^。；！？!?]{0,100}?(?:目前)?重点(?:学习|关注)\s*([^，。；！？!?]{1,80}))"),
    ("preference", "回答方式", 0.95, r"(我偏好\s*([^。；！？!?]{2,160}))"),
    ("preference", "回答方式", 0.92, r"(我希望\s*((?:以后|今后|回答时|答案|安全问题的回答)[^。；！？!?]{1,160}))"),
)
# Limits of summaries and of memory in a prompt.
SUMMARY_CHARS, MESSAGE_CHARS = 1200, 500
SESSION_FACTS, PERSONAL_ITEMS, CONTEXT_CHARS = 6, 5, 1600

_SHAPE = r"^OBJECT<confidence: (?:BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\s?\d+\)), evidence: STRING, key: STRING, memory_type: STRING, (?:ttl_days: (?:BIGINT|VOID), )?value: STRING>$"
_ITEM = "struct<memory_type:string,key:string,value:string,confidence:double,ttl_days:bigint,evidence:string>"


def is_first_person(text: Column) -> Column:
    """M-09: whether a text speaks of its writer and of nobody else."""
    return text.rlike(FIRST_PERSON) & ~text.rlike(OTHERS)


def is_sensitive(text: Column) -> Column:
    """M-09: whether a text touches secrets, contacts, papers, health or money."""
    return text.rlike(SENSITIVE)


def _once(items: Column) -> Column:
    """Of items the first of each type and key, whatever its case."""
    identity = lambda f: F.concat_ws(":", f["memory_type"], F.lower(f["key"]))
    return let(items, lambda fs: let(F.transform(fs, identity), lambda ids: F.filter(fs, lambda f, i: F.array_position(ids, identity(f)) == i + 1)))


def parse_personal(turns: DataFrame, payload: str, message: str) -> DataFrame:
    """M-07: turns with memory_type, key, value, confidence, ttl_days and evidence, a row for each memory of the payload.

    A payload is a JSON object, alone or in one code fence, with `memories` only: at most 5 objects of exactly memory_type, key, value,
    confidence, evidence and, if they like, ttl_days. All of them must hold, else there is no row: a known type; key, value and
    evidence filled, of at most 120, 500 and 500 characters once white space is collapsed; confidence a number from 0 to 1;
    ttl_days null or a whole number from 1 to 365; evidence that stands in the message (of at most 500 characters), speaks of
    its writer alone, and with key and value touches nothing sensitive. Of one type and key the first stays.
    """
    fenced = F.regexp_extract(payload, r"(?is)^\s*```(?:json)?[ \t]*\r?\n(.*?)\r?\n?```\s*$", 1)
    body = F.when(F.col(payload).rlike(r"(?is)^\s*```(?:json)?[ \t]*\r?\n(.*?)\r?\n?```\s*$"), fenced).otherwise(F.col(payload))
    said = collapse(F.col(message))
    rows = turns.withColumns({"_body": body, "_said": said}).where(F.length("_said").between(1, VALUE_CHARS))
    rows = rows.withColumn("_v", F.try_parse_json("_body")).where(F.schema_of_variant("_v").startswith("OBJECT"))
    keys = F.json_object_keys("_body")
    rows = rows.withColumn("_list", F.when((F.size(keys) == 1) & (F.get(keys, F.lit(0)) == "memories") & F.schema_of_variant(F.try_variant_get("_v", "$.memories", "variant")).startswith("ARRAY"), F.try_variant_get("_v", "$.memories", "array<variant>")))
    rows = rows.where(F.col("_list").isNotNull() & (F.size("_list") <= MOST) & F.forall("_list", lambda e: F.schema_of_variant(e).rlike(_SHAPE)))
    get = lambda e, name, kind: F.try_variant_get(e, f"$.{name}", kind)
    item = lambda e: F.struct(
        get(e, "memory_type", "string").alias("memory_type"), collapse(get(e, "key", "string")).alias("key"), collapse(get(e, "value", "string")).alias("value"),
        get(e, "confidence", "double").alias("confidence"), get(e, "ttl_days", "bigint").alias("ttl_days"), collapse(get(e, "evidence", "string")).alias("evidence"),
    )
    rows = rows.withColumn("_items", F.transform("_list", item))
    right = lambda f: F.coalesce(
        f["memory_type"].isin(*TYPES) & F.length(f["key"]).between(1, KEY_CHARS) & F.length(f["value"]).between(1, VALUE_CHARS) & F.length(f["evidence"]).between(1, VALUE_CHARS)
        & f["confidence"].between(0, 1) & (f["ttl_days"].isNull() | f["ttl_days"].between(1, TTL_DAYS)) & F.contains("_said", f["evidence"]) & is_first_person(f["evidence"])
        & ~is_sensitive(F.concat_ws(" ", f["key"], f["value"], f["evidence"])),
        F.lit(False),
    )
    rows = rows.where(F.forall("_items", right)).withColumn("_f", F.explode(_once(F.col("_items"))))
    return rows.select(*turns.columns, "_f.*")


def extract_self_statements(turns: DataFrame, message: str) -> DataFrame:
    """M-08: turns with memory_type, key, value, confidence and evidence, a row for each rule that finds a statement of the writer.

    The message is read with white space collapsed, if it is filled and of at most 500 characters. A statement that names others
    or touches sensitive matters is left out; of one type and key the first rule's stays.
    """
    rows = turns.withColumn("_said", collapse(F.col(message))).where(F.length("_said").between(1, VALUE_CHARS))
    found = [
        F.struct(
            F.lit(kind).alias("memory_type"), F.lit(key).alias("key"), F.trim(F.regexp_extract("_said", rule, 2)).alias("value"), F.lit(sure).alias("confidence"),
            F.trim(F.regexp_extract("_said", rule, 1)).alias("evidence"),
        )
        for kind, key, sure, rule in RULES
    ]
    good = lambda f: (f["value"] != "") & is_first_person(f["evidence"]) & ~is_sensitive(F.concat_ws(" ", f["key"], f["value"], f["evidence"]))
    rows = rows.withColumn("_f", F.explode(F.slice(_once(F.filter(F.array(*found), good)), 1, MOST)))
    return rows.select(*turns.columns, "_f.*")


def _bounded(text: Column, most: int) -> Column:
    """The text with white space collapsed; null if that is empty or too long."""
    flat = collapse(text)
    return F.when(F.length(flat).between(1, most), flat)


def build_summary(turns: DataFrame, facts: str) -> DataFrame:
    """M-03: turns (prior, user, assistant and an array of facts with memory_type, key, value) with summary, cut to 1200 characters.

    A turn whose user or assistant text is blank or has more than 500 characters gets null; a prior summary that is blank or has
    more than 1200 is left out, not cut. Null facts are none.
    """
    prior, user, assistant = _bounded(F.col("prior"), SUMMARY_CHARS), _bounded(F.col("user"), MESSAGE_CHARS), _bounded(F.col("assistant"), MESSAGE_CHARS)
    listed = F.transform(facts, lambda f: F.concat(f["memory_type"], F.lit(":"), f["key"], F.lit("="), f["value"]))
    memory = F.when(F.size(facts) > 0, F.concat(F.lit("Working memory: "), F.array_join(listed, "; ")))
    lines = F.concat_ws("\n", F.concat(F.lit("Prior: "), prior), F.concat(F.lit("User: "), user), F.concat(F.lit("Assistant: "), assistant), memory)
    return turns.withColumn("summary", F.when(user.isNotNull() & assistant.isNotNull(), F.substring(lines, 1, SUMMARY_CHARS)))


def _filled(facts: Column, most: int) -> Column:
    good = lambda f: F.coalesce((F.trim(f["memory_type"]) != "") & (F.trim(f["key"]) != "") & (F.trim(f["value"]) != ""), F.lit(False))
    kept = F.slice(F.filter(F.coalesce(facts, F.array().cast("array<struct<memory_type:string,key:string,value:string>>")), good), 1, most)
    return F.transform(kept, lambda f: F.concat(f["memory_type"], F.lit(": "), f["key"], F.lit("="), f["value"]))


def format_session_memory(summary: Column, facts: Column) -> Column:
    """M-06: a session's summary and its first 6 filled facts as text of at most 1600 characters."""
    lines, said = _filled(facts, SESSION_FACTS), F.regexp_replace(F.coalesce(summary, F.lit("")), r"^\s+|\s+$", "")
    parts = F.concat_ws("\n", F.when(said != "", F.concat(F.lit("Summary: "), said)), F.when(F.size(lines) > 0, F.concat(F.lit("Working memory: "), F.array_join(lines, "; "))))
    return F.substring(parts, 1, CONTEXT_CHARS)


def format_personal_memories(memories: Column) -> Column:
    """M-06: the first 5 filled memories, a line each, as text of at most 1600 characters."""
    return F.substring(F.array_join(_filled(memories, PERSONAL_ITEMS), "\n"), 1, CONTEXT_CHARS)
