"""Column functions on questions: follow-ups, rewriting, keywords and retry queries. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, let

# Phrases and patterns that classify a question.
FOLLOW_UP = r"(?i)^(?:and\s+then|then|what\s+about|how\s+about|continue|tell\s+me\s+more)\b"
FOLLOW_UP_PREFIXES = ("那", "那么", "继续", "上述", "前面", "刚才", "上一", "下一步")
ANSWER_REFERENCE = r"(?i)\b(?:first|second|third|previous|former|latter)\s+(?:step|option|approach|plan)\b"
ANSWER_MARKERS = ("第一步", "第二步", "第三步", "前一种方案", "后一种方案", "你刚才的回答")
COMPARISON = r"(?i)(?:区别|对比|比较|优缺点|\bvs\.?\b|\bversus\b|\bcompare\b)"
MULTI_CONSTRAINT = r"(?i)(?:在.*情况下|当.*时|同时|分别|以及|并且|\bwhen\b.*\b(?:and|or)\b|\bwith\b.*\b(?:and|or)\b)"
DIAGNOSTIC_ORDER = r"(?i)(?:排查.*(?:顺序|步骤)|先.*再|\b(?:diagnos|troubleshoot|investigat)\w*\b.*\b(?:order|step)\b)"
EXPLANATION = r"(?i)^(?:explanation|answer|rewritten\s+query|here(?:'s| is)|the\s+(?:query|answer)|解释|答案|改写(?:后的)?查询)\s*[:：]"
LIST_OR_FENCE = r"^(?:[-*+]\s+|#{1,6}\s+|```)"
VAGUE = ("这个怎么处理", "那个怎么处理", "它怎么处理", "这个怎么办", "那个怎么办", "它怎么办", "有什么要求", "怎么走", "怎么弄", "怎么处理")
ANCHORS = ("接口", "500", "流程", "制度", "审批", "报销", "权限", "变更", "发布", "故障")
VAGUE_WHOLE = ("怎么办", "怎么做", "要求", "流程", "处理")
STOP_WORDS = ("what", "when", "where", "which", "how", "does", "the", "and", "for")
WEAK_TERMS = ("exact", "specific", "detailed", "current", "first step", "具体", "详细", "当前", "第一步", "这个", "那个")
REWRITE_CHARS = (2, 240)
RETRY_QUERIES = 3


def _any(text: Column, markers: tuple[str, ...], how=F.contains) -> Column:
    hits = [how(text, F.lit(m)) for m in markers]
    found = hits[0]
    for h in hits[1:]:
        found = found | h
    return found


def references_answer(question: Column) -> Column:
    return _any(question, ANSWER_MARKERS) | question.rlike(ANSWER_REFERENCE)


def is_follow_up(question: Column) -> Column:
    """Of a normalised question: whether it continues the one before, or refers to the answer given."""
    return _any(question, FOLLOW_UP_PREFIXES, F.startswith) | question.rlike(FOLLOW_UP) | references_answer(question)


def is_complex(question: Column) -> Column:
    return question.rlike(COMPARISON) | question.rlike(MULTI_CONSTRAINT) | question.rlike(DIAGNOSTIC_ORDER)


def is_vague(question: Column) -> Column:
    text = F.lower(F.trim(question))
    return (text == "") | F.when(_any(text, VAGUE), ~_any(text, ANCHORS)).otherwise(text.isin(*VAGUE_WHOLE))


def prefers_chinese(text: Column) -> Column:
    return text.rlike(r"[\x{4E00}-\x{9FFF}]")


# What is answered where the sources don't tell.
UNSUPPORTED = "Unable to determine from the current sources. "
UNSUPPORTED_ZH = "根据当前资料无法确定。还需要补充"


def unsupported_answer(question: Column, missing: Column) -> Column:
    """Q-09: the answer in the question's language where the sources don't tell, with what is missing if that is known."""
    lack = F.trim(F.coalesce(missing, F.lit("")))
    chinese = F.when(lack != "", F.concat(F.lit(UNSUPPORTED_ZH + "："), lack)).otherwise(UNSUPPORTED_ZH + "相关资料后再回答。")
    other = F.when(lack != "", F.concat(F.lit(UNSUPPORTED + "Additional information needed: "), lack)).otherwise(UNSUPPORTED + "Add relevant source material before answering.")
    return F.when(prefers_chinese(F.coalesce(question, F.lit(""))), chinese).otherwise(other)


def retrieval_query(current: Column, prior_user: Column, prior_answer: Column) -> Column:
    """The question, or for a follow-up labelled lines of prior question, prior answer if it is meant, and question."""
    answer = F.when(references_answer(current), F.concat(F.lit("Previous assistant answer: "), prior_answer))
    lines = F.concat_ws("\n", F.concat(F.lit("Previous user question: "), prior_user), answer, F.concat(F.lit("Current follow-up: "), current))
    return F.when(prior_user.isNotNull() & is_follow_up(current), lines).otherwise(current)


def valid_rewrite(value: Column) -> Column:
    """The trimmed rewriting if it is one line of plain text of fitting length, else null."""
    text = F.regexp_replace(value, r"^\s+|\s+$", "")
    bad = text.rlike(r"[\r\n]") | text.rlike(LIST_OR_FENCE) | text.rlike(EXPLANATION) | F.try_parse_json(text).isNotNull()
    return F.when(F.length(text).between(*REWRITE_CHARS) & ~bad, text)


def distinct_ignoring_case(values: Column) -> Column:
    """Non-blank strings of an array, the first of those that differ in case or outer space only."""
    folded = lambda v: F.lower(F.trim(v))
    first = lambda both: F.filter(both["v"], lambda v, i: (F.trim(v) != "") & (F.array_position(both["k"], folded(v)) == i + 1))
    return let(values, lambda vs: let(F.struct(vs.alias("v"), F.transform(vs, folded).alias("k")), first))


def exclude(values: Column, attempted: Column) -> Column:
    tried = F.transform(attempted, lambda v: F.lower(F.trim(v)))
    return let(tried, lambda t: F.filter(values, lambda v: ~F.array_contains(t, F.lower(F.trim(v)))))


def keywords(question: Column) -> Column:
    """Words of two characters or more without outer punctuation and stop words, distinct but for case."""
    marks = r".:;；：()（）\[\]【】"
    tokens = F.transform(F.split(F.regexp_replace(question, "[?？,，]", " "), r"\s+"), lambda t: F.regexp_replace(t, f"^[{marks}]+|[{marks}]+$", ""))
    return distinct_ignoring_case(F.filter(tokens, lambda t: (F.length(t) >= 2) & ~F.lower(t).isin(*STOP_WORDS)))


def strip_weak_terms(question: Column) -> Column:
    """The question without words that only narrow it; as it was if nothing stays."""
    text = question
    for term in WEAK_TERMS:
        text = F.replace(text, F.lit(term), F.lit(" "))
    return F.coalesce(F.nullif(collapse(text), F.lit("")), question)


def _first_words(question: Column, n: int) -> Column:
    parts = F.split(question, r"\s+")
    return F.when(F.size(parts) > n, F.array_join(F.slice(parts, 1, n), " "))


def retry_queries(strategy: Column, rewritten: Column, question: Column, attempted: Column) -> Column:
    """At most three queries to try next: broader ones, ones with process terms, or keywords; none tried before."""
    broad = [q for plain in (strip_weak_terms(rewritten), strip_weak_terms(question)) for q in (plain, _first_words(plain, 3), _first_words(plain, 2))]
    process = [rewritten, *[F.concat(q, F.lit(" process conditions steps requirements")) for q in (question, rewritten)]]
    head = lambda found, k, *more: F.array_join(F.concat(F.slice(found, 1, k), *more), " ")
    words = lambda found: F.array(
        F.when(F.size(found) > 0, head(found, 4)), F.when(F.size(found) >= 3, head(found, 2, F.slice(found, -1, 1))),
        F.when(F.size(found) >= 2, head(found, 2, F.array(F.lit("process"), F.lit("requirements")))),
    )
    made = (
        F.when(strategy == "broaden", F.array_compact(F.array(*broad))).when(strategy == "query_rewrite", F.array(*process))
        .when(strategy.isin("keyword", "entity_expand"), F.array_compact(let(keywords(rewritten), words))).otherwise(F.array(rewritten))
    )
    return F.slice(exclude(distinct_ignoring_case(made), attempted), 1, RETRY_QUERIES)
