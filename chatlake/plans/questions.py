"""Questions in natural language: schema for the prompt, a gate for generated SQL, retrieval for answers. The model is a function the caller brings."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.functions.text import contains_any_case
from chatlake.operators.dedup import first_copies
from chatlake.operators.fulltext import Index, search_words

Model = Callable[[str], str]
SHOWN = 20


def describe(spark: SparkSession, views: list[str]) -> str:
    """The real columns of the views, one line a view."""
    return "\n".join(f"{view}({', '.join(f'{c.name} {c.dataType}' for c in spark.catalog.listColumns(view))})" for view in views)


def prompt(question: str, schema: str) -> str:
    return f"Tables:\n{schema}\n\nWrite one Spark SQL query (SELECT or WITH) that answers the question. Times are epoch seconds in UTC. Return SQL only.\n\nQuestion: {question}\nSQL:"


def extract_sql(answer: str) -> str:
    """The query in a model's answer: without code fences, from the first WITH or SELECT to the first semicolon."""
    bare = re.sub(r"```(?:sql)?", "", answer, flags=re.IGNORECASE).strip()
    found = re.search(r"\b(WITH|SELECT)\b[^;]*", bare, re.IGNORECASE | re.DOTALL)
    if not found:
        raise ValueError("no query in the answer")
    return found[0].strip()


# Functions a generated query may call; all are free of side effects and read nothing but their arguments.
ALLOWED_FUNCTIONS = frozenset(
    """count sum avg mean min max first last any_value count_if stddev stddev_pop stddev_samp variance var_pop var_samp median percentile percentile_approx approx_count_distinct collect_list collect_set max_by min_by mode
    row_number rank dense_rank percent_rank ntile lag lead abs round bround floor ceil ceiling sqrt power pow exp ln log log2 log10 mod pmod sign greatest least coalesce nullif nvl ifnull if isnull isnotnull case when
    lower upper trim ltrim rtrim length char_length substring substr concat concat_ws replace regexp_replace regexp_extract regexp_like regexp_count instr locate position split left right lpad rpad reverse contains startswith endswith like ilike rlike initcap
    from_unixtime unix_timestamp to_timestamp to_date date_format date_trunc trunc year month day dayofmonth dayofweek dayofyear weekday weekofyear quarter hour minute second date_add date_sub datediff months_between add_months timestamp_seconds
    array size explode sequence array_contains array_distinct array_sort element_at struct map cast try_cast int bigint double string date timestamp not in and or + - * / % = == <=> < <= > >= ! || between extract date_part""".split()
)
# Parts of a query plan that may hold rows without reading a table, and those that run or name something else.
_ROWS = ("OneRowRelation", "LocalRelation", "CTERelationRef")
_REFUSED = ("ScriptTransformation", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "UnresolvedIdentifier", "NamedParameter", "PosParameter")


def _views_read(plan, views: set[str]) -> None:
    """Refuse an analysed plan any leaf of which isn't inside one of the views, subqueries included."""
    name = plan.nodeName()
    if name == "View":
        read = plan.desc().identifier().table()
        if read not in views:
            raise ValueError(f"not allowed: {read}")
        return
    inner = [*_listed(plan.children()), *_listed(plan.subqueries())]
    if not _listed(plan.children()) and name not in _ROWS:
        raise ValueError(f"not allowed: {plan.simpleString(5)}")
    for part in inner:
        _views_read(part, views)


def _listed(items) -> list:
    return [items.apply(i) for i in range(items.length())]


def gate(spark: SparkSession, sql: str, views: list[str]) -> DataFrame:
    """The frame of a query that reads only the given views and calls only listed functions; anything else is refused before it runs.

    The parsed text is looked at first: relations must have one name, so no file and no other schema is opened while names are
    resolved. Then the analysed plan: every leaf must lie inside a given view, however the query names it.
    """
    shown = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000000")
    try:
        text = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", shown)
    if not re.match(r"(?is)\s*(with|select)\b", sql) or re.search(r"(?i)\b(insert|update|delete|create|drop|alter|merge|truncate)\b\s+\w", sql):
        raise ValueError("only queries are allowed")
    if found := [name for name in _REFUSED if name in text]:
        raise ValueError(f"not allowed: {found}")
    if found := [names for names in re.findall(r"UnresolvedRelation \[([^\]]*)\]", text) if "," in names]:
        raise ValueError(f"not allowed: {found}")
    called = {name.lower() for name in re.findall(r"'`?([\w.|!<>=%*/+-]+)`?\(", text)}
    if unknown := called - ALLOWED_FUNCTIONS:
        raise ValueError(f"functions not allowed: {sorted(unknown)}")
    frame = spark.sql(sql)
    _views_read(frame._jdf.queryExecution().analyzed(), set(views))
    return frame


def answer_with_sql(spark: SparkSession, question: str, model: Model, views: list[str], generate_answer: bool = True) -> dict:
    """sql, rows (at most SHOWN) and answer, or error."""
    try:
        sql = extract_sql(model(prompt(question, describe(spark, views))))
        rows = [r.asDict(recursive=True) for r in gate(spark, sql, views).limit(SHOWN).collect()]
    except (ValueError, AnalysisException, ParseException) as error:
        return {"error": str(error).split("\n")[0]}
    found = {"sql": sql, "rows": rows}
    return found | {"answer": model(f"Question: {question}\nRows: {rows}\nAnswer:")} if generate_answer else found


def merged(keyword: DataFrame, recent: DataFrame) -> DataFrame:
    """Keyword hits before recent messages, each text once."""
    both = keyword.withColumn("source", F.lit(0)).unionByName(recent.withColumn("source", F.lit(1)))
    return first_copies(both, ["text_plain"], [F.col("source"), F.desc("date_unixtime"), F.col("id")]).orderBy("source", F.desc("date_unixtime"), "id")


def retrieve(messages: DataFrame, index: Index, user: str | None, keywords: list[str]) -> DataFrame:
    """Messages for a question about a user, keywords, both or neither: by user and keyword (with the user's recent ones), by user, by keyword, or the latest."""

    def newest(rows: DataFrame, n: int) -> DataFrame:
        return rows.orderBy(F.desc("date_unixtime"), "id").limit(n)

    words = [w for w in keywords[:10] if w.strip()]
    by_user = messages.where(contains_any_case(F.col("from_name"), user)) if user else messages
    if not words:
        return newest(by_user, 200 if user else 100)
    hits = newest(by_user.join(search_words(index, words, every=False), "id", "left_semi"), 100)
    return merged(hits, newest(by_user, 50)) if user else hits


def answer_from_context(question: str, rows: list[str], model: Model) -> str:
    """The model's answer from retrieved lines."""
    lines = "\n".join(rows)
    return model(f"Answer from these messages only.\n{lines}\n\nQuestion: {question}\nAnswer:")


def dispatch(mode: str, by_sql: Callable[[], dict], by_context: Callable[[], dict], by_meaning: Callable[[], dict]) -> dict:
    """Run a mode; auto tries SQL and falls back to context when it fails or finds nothing."""
    if mode == "sql":
        return by_sql()
    if mode == "context":
        return by_context()
    if mode == "semantic":
        return by_meaning()
    first = by_sql()
    return by_context() if first.get("error") or not first.get("rows") else first
