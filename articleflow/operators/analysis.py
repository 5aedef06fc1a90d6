"""Analysis of article groups: capped and budgeted prompts, one model call per group, stored runs."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from articleflow.functions.prompts import ANALYSIS_BODY_LIMIT, ANALYSIS_SYSTEM, analysis_block, analysis_prompt
from articleflow.functions.replies import parse_analysis
from articleflow.operators.completion import Client, with_completion
from articleflow.operators.journal import with_journal
from articleflow.operators.query import article_order, filter_articles
from articleflow.schemas import ANALYSIS_RUNS
from articleflow.session import materialize

# How many articles and characters go into one request.
MAX_ARTICLES, MAX_CHARS = 50, 20000


def analysis_cap(limit: int | None, max_articles: int = MAX_ARTICLES) -> int:
    if limit is not None and limit < 1:
        raise ValueError("limit must be 1 or more")
    return min(limit or max_articles, max_articles)


def analysis_blocks(
    clean: DataFrame, *, by: tuple[str, ...] = (), limit: int | None = None, max_articles: int = MAX_ARTICLES,
    max_chars: int = MAX_CHARS, body_limit: int = ANALYSIS_BODY_LIMIT, **filters,
) -> DataFrame:
    """The numbered blocks that fit a request, per group: ``by columns, number, id, block, running_length``.

    The newest articles of a group come first, at most ``max_articles``. Blocks are taken while their lengths
    add up to at most ``max_chars``, the first one always; separators are not counted. The cap is pushed below
    the shuffle, so a hot group sends at most that many rows per task, and the sum runs over capped rows only.
    """
    cap = analysis_cap(limit, max_articles)
    newest = Window.partitionBy(*by).orderBy(*article_order(True))
    rows = filter_articles(clean, **filters).select(
        *by, *[c for c in ("id", "title", "source", "category", "published_at", "collected_at", "summary", "body") if c not in by]
    )
    if by:
        capped = rows.withColumn("number", F.row_number().over(newest)).where(F.col("number") <= cap)
    else:
        capped = rows.orderBy(*article_order(True)).limit(cap).withColumn("number", F.row_number().over(newest))
    blocks = capped.withColumn("block", analysis_block("number", body_limit)).select(*by, "number", "id", "block")
    running = F.sum(F.length("block")).over(
        Window.partitionBy(*by).orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    )
    summed = blocks.withColumn("running_length", running)
    return summed.where((F.col("running_length") <= max_chars) | (F.col("number") == 1))


def analysis_requests(
    blocks: DataFrame, *, by: tuple[str, ...] = (), category: str | Column | None = None,
    date_from: str | None = None, date_to: str | None = None,
) -> DataFrame:
    """One prompt per group with ``article_count``; a group without articles gives no row."""
    ordered = F.array_sort(F.collect_list(F.struct("number", "block")))
    text = F.array_join(F.transform(ordered, lambda item: item["block"]), "\n\n")
    grouped = blocks.groupBy(*by).agg(F.count("*").alias("article_count"), text.alias("_articles"))
    if category is None and "category" in by:
        category = F.col("category")
    elif not isinstance(category, Column):
        category = F.lit(category).cast("string")
    prompt = analysis_prompt("_articles", "article_count", category, date_from, date_to)
    return grouped.where(F.col("article_count") > 0).select(*by, "article_count", prompt.alias("prompt"))


@dataclass(frozen=True)
class AnalyzeResult:
    """New rows for ``analysis_runs``, and the groups whose call or reply failed with the reason."""

    runs: DataFrame
    failures: DataFrame


def analyze(
    clean: DataFrame, runs: DataFrame, factory: Callable[[], Client], *, model: str | None = None,
    by: tuple[str, ...] = (), date_from: str | None = None, date_to: str | None = None, category: str | None = None,
    limit: int | None = None, max_articles: int = MAX_ARTICLES, max_chars: int = MAX_CHARS,
    stage_path: str | None = None, journal: str | None = None,
) -> AnalyzeResult:
    """One model call per group (one in all without ``by``); only valid replies become runs.

    Replies are stored before they are read twice; in a ``journal`` (a path) they outlive a job that dies. No matching article gives no call and no run.
    """
    blocks = analysis_blocks(
        clean, by=by, limit=limit, max_articles=max_articles, max_chars=max_chars,
        date_from=date_from, date_to=date_to, category=category,
    )
    requests = analysis_requests(blocks, by=by, category=category, date_from=date_from, date_to=date_to)
    keyed = requests.withColumn("_key", F.concat_ws("/", *by) if by else F.lit(""))
    if journal is None:
        called = with_completion(keyed, factory, system=ANALYSIS_SYSTEM, key="_key", json_mode=True).withColumn("created_at", F.current_timestamp())
    else:
        noted = with_journal(keyed, factory, journal, system=ANALYSIS_SYSTEM, key="_key", json_mode=True, model=model or "", per_task=1)
        called = noted.withColumnRenamed("called_at", "created_at")
    answered = materialize(called, stage_path, "analysis")
    checked = answered.withColumn("_a", parse_analysis("reply"))
    error = F.coalesce(F.col("error"), F.col("_a.error"))
    run_category = F.col("category") if "category" in by else F.lit(category).cast("string")
    good = checked.where(error.isNull())

    # One row per model call, so numbering them in one window is no burden.
    last = runs.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    number = F.row_number().over(Window.orderBy("_key"))
    fields = {
        "id": (last + number).cast("long"),
        "date_from": F.lit(date_from).cast("string"),
        "date_to": F.lit(date_to).cast("string"),
        "category": run_category,
        "article_count": F.col("article_count"),
        "trends": F.col("_a.trends"),
        "keywords": F.col("_a.keywords"),
        "commonalities_differences": F.col("_a.commonalities_differences"),
        "implications": F.col("_a.implications"),
        "model": F.lit(model).cast("string"),
        "created_at": F.col("created_at"),
    }
    new_runs = good.select(*[fields[name].alias(name) for name in ANALYSIS_RUNS.names])
    failures = checked.where(error.isNotNull()).select(*by, "article_count", "reply", error.alias("error"))
    return AnalyzeResult(new_runs, failures)


def latest_analysis(
    runs: DataFrame, *, date_from: str | None = None, date_to: str | None = None, category: str | None = None
) -> DataFrame:
    """The newest run that matches the given conditions, else the newest of all, with ``is_fallback``. One pass."""
    wanted = {"date_from": date_from, "date_to": date_to, "category": category}
    matches = F.lit(True)
    for name, value in wanted.items():
        if value:
            matches = matches & F.coalesce(F.col(name) == value, F.lit(False))
    ranked = runs.withColumn("is_fallback", ~matches)
    return ranked.orderBy(F.asc("is_fallback"), F.desc("id")).limit(1)


def latest_analysis_by(runs: DataFrame, *by: str) -> DataFrame:
    """The newest run of every group."""
    rest = [name for name in runs.columns if name not in by]
    return runs.groupBy(*by).agg(F.max_by(F.struct(*rest), "id").alias("_run")).select(*by, "_run.*")


def attach_latest(rows: DataFrame, runs: DataFrame, **conditions) -> DataFrame:
    """``rows`` with the latest matching run as struct column ``analysis`` (NULL when there is none)."""
    latest = latest_analysis(runs, **conditions)
    return rows.withColumn("analysis", latest.select(F.struct(*latest.columns)).scalar())
