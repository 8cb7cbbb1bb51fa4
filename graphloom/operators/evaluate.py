"""Evaluation of paths and answers: step-wise texts, judges, scores and result rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.lexicon import RISK_DIRECTIONS

from .graph import path_text
from .responses import CompletionProvider, clean_json, complete, json_error

# What is scored, from 0 to 2 each, and the columns of result files.
PATH_ITEMS = ("path_continuity", "evidence_coverage", "direction_consistency", "cascade_relevance", "path_quality")
ANSWER_ITEMS = ("context_relevance", "faithfulness", "relationship_direction", "completeness", "answer_relevance")
PATH_COLUMNS = ("path", "hop_count", *PATH_ITEMS, "total_score", "unsupported_steps", "direction_errors", "explanation")
ANSWER_COLUMNS = ("question_id", "question_type", "question", "start_company", "target_company", "selected_paths", *ANSWER_ITEMS, "total_score", "unsupported_claims", "direction_errors", "explanation", "answer")


def risk_rules(spark) -> DataFrame:
    """relation, direction: the one table of where risk goes."""
    return spark.createDataFrame(list(RISK_DIRECTIONS.items()), "relation string, direction string")


def step_text(path: Column, relationships: Column) -> Column:
    """The path step by step, each with the relations between its two companies, in either direction."""

    def relation(r: Column) -> Column:
        return F.concat_ws("\n", F.concat(r["head"], F.lit(" --"), r["relation"], F.lit("--> "), r["tail"]), F.concat(F.lit("Source: "), F.coalesce(r["source_file"], F.lit(""))), F.concat(F.lit("Evidence: "), F.coalesce(r["source_sentence"], F.lit(""))))

    def step(i: Column) -> Column:
        left, right = F.get(path, i - 1), F.get(path, i)
        mine = F.filter(relationships, lambda r: ((r["head"] == left) & (r["tail"] == right)) | ((r["head"] == right) & (r["tail"] == left)))
        return F.concat_ws("\n", F.format_string("STEP %d: %s -> %s", i, left, right), *[F.when(F.size(mine) > 0, F.array_join(F.transform(mine, relation), "\n"))], F.lit(""))

    steps = F.when(F.size(path) > 1, F.transform(F.sequence(F.lit(1), F.size(path) - 1), step)).otherwise(F.array().cast("array<string>"))
    return F.concat_ws("\n", F.concat(F.lit("Path: "), path_text(path)), F.format_string("Hop count: %d", F.size(path) - 1), F.lit(""), F.array_join(steps, "\n"))


def rule_judge(evidence: DataFrame) -> DataFrame:
    """evidence (path, relationships) with the path items scored without a model: 2 where every step holds, 1 where some do, else 0."""
    path, rels = F.col("path"), F.col("relationships")
    numbers = F.sequence(F.lit(1), F.size(path) - 1)

    def backed(i: Column) -> Column:
        return F.exists(rels, lambda r: ((r["head"] == F.get(path, i - 1)) & (r["tail"] == F.get(path, i))) | ((r["head"] == F.get(path, i)) & (r["tail"] == F.get(path, i - 1))))

    def carried(i: Column) -> Column:
        ahead = lambda r: r["relation"].isin(*[k for k, d in RISK_DIRECTIONS.items() if d == "forward"]) & (r["head"] == F.get(path, i - 1)) & (r["tail"] == F.get(path, i))
        back = lambda r: r["relation"].isin(*[k for k, d in RISK_DIRECTIONS.items() if d == "reverse"]) & (r["tail"] == F.get(path, i - 1)) & (r["head"] == F.get(path, i))
        return F.exists(rels, lambda r: ahead(r) | back(r))

    def name(i: Column) -> Column:
        return F.concat(F.get(path, i - 1), F.lit(" -> "), F.get(path, i))

    def score(missing: Column) -> Column:
        return F.when(F.size(missing) == 0, 2).when(F.size(missing) < F.size(path) - 1, 1).otherwise(0)

    out = evidence.filter(F.size(path) > 1).withColumn("unsupported_steps", F.transform(F.filter(numbers, lambda i: ~F.coalesce(backed(i), F.lit(False))), name)).withColumn("direction_errors", F.transform(F.filter(numbers, lambda i: ~F.coalesce(carried(i), F.lit(False))), name))
    simple = F.when(F.size(F.array_distinct(path)) == F.size(path), 2).otherwise(0)
    scores = {"path_continuity": score(F.col("unsupported_steps")), "evidence_coverage": score(F.col("unsupported_steps")), "direction_consistency": score(F.col("direction_errors")), "cascade_relevance": score(F.col("direction_errors")), "path_quality": simple}
    return total(out.withColumns(scores).withColumn("explanation", F.lit("scored by rule")), PATH_ITEMS)


def rule_judge_answers(answers: DataFrame) -> DataFrame:
    """answers of answer_questions() scored without a model: does the evidence name the start, and the target if there is one; are
    the hop counts that the answer gives within the evidence's; does the answer name start and target; is it of 1 to 250 words."""
    named = lambda text, name: F.coalesce(name.isNull() | F.contains(F.lower(text), F.lower(name)), F.lit(True))
    answer, context, start, target = F.coalesce("answer", F.lit("")), F.coalesce("context", F.lit("")), F.col("start"), F.col("target")
    hops = F.transform(F.regexp_extract_all(answer, F.lit(r"(\d+) ?-?hop"), 1), lambda h: h.cast("int"))
    far = F.filter(hops, lambda h: h > F.coalesce("max_depth", F.lit(0)))
    words = F.size(F.filter(F.split(answer, r"\s+"), lambda w: w != ""))
    scores = {
        "context_relevance": F.when(named(context, start), 1).otherwise(0) + F.when(named(context, target), 1).otherwise(0),
        "faithfulness": F.when(F.size(far) == 0, 2).otherwise(0),
        "relationship_direction": F.when(F.contains(context, F.lit("--")), 2).otherwise(0),
        "completeness": F.when(named(answer, start), 1).otherwise(0) + F.when(named(answer, target), 1).otherwise(0),
        "answer_relevance": F.when(words.between(1, 250), 2).otherwise(0),
    }
    claims = F.transform(far, lambda h: F.format_string("%d hops", h))
    out = answers.withColumns(scores).withColumns({"unsupported_claims": claims, "direction_errors": F.array().cast("array<string>"), "explanation": F.lit("scored by rule")})
    return total(out, ANSWER_ITEMS)


def model_judge(cases: DataFrame, text: str, items: tuple[str, ...], lists: tuple[str, str], make: Callable[[], CompletionProvider]) -> DataFrame:
    """cases with the judgement of a model on column `text`: the items, two lists and an explanation, from strict JSON; a row whose
    answer is no JSON keeps its error and null scores."""
    rules = "; ".join(f"{r}: {'head to tail' if d == 'forward' else 'tail to head'}" for r, d in RISK_DIRECTIONS.items())
    ask = f"Judge the evidence below by itself. Risk goes by relation: {rules}. Score 0 to 2: {', '.join(items)}. Answer with JSON only: these as numbers, {lists[0]} and {lists[1]} as lists of strings, explanation as a string.\n\n"
    answered = complete(cases.withColumn("prompt", F.concat(F.lit(ask), F.col(text))), make)
    body = clean_json(F.col("response"))
    kind = ", ".join([*[f"{i} int" for i in items], *[f"{x} array<string>" for x in lists], "explanation string"])
    bad = json_error(body)
    out = answered.withColumn("error", F.coalesce("error", bad)).withColumn("__j", F.when(F.col("error").isNull(), F.from_json(body, kind)))
    return total(out.select(*[c for c in out.columns if c not in ("__j", "prompt", "response")], "__j.*"), items)


def total(scored: DataFrame, items: tuple[str, ...]) -> DataFrame:
    return scored.withColumn("total_score", sum((F.col(i) for i in items[1:]), F.col(items[0])))


def path_rows(judged: DataFrame) -> DataFrame:
    """The rows of the path result file."""
    out = judged.withColumn("hop_count", F.size("path") - 1).withColumn("path", path_text(F.col("path")))
    return _joined(out, ("unsupported_steps", "direction_errors")).select(*PATH_COLUMNS)


def answer_rows(judged: DataFrame) -> DataFrame:
    """The rows of the answer result file, from answer_questions() with judgements."""
    names = {"id": "question_id", "type": "question_type", "start": "start_company", "target": "target_company"}
    return _joined(judged.withColumnsRenamed(names), ("unsupported_claims", "direction_errors")).select(*ANSWER_COLUMNS)


def _joined(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.withColumns({c: F.array_join(c, "; ") for c in columns})


def mean_score(rows: DataFrame) -> DataFrame:
    return rows.agg(F.format_string("%.1f", F.avg("total_score")).alias("average"))
