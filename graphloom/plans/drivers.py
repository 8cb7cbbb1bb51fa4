"""Drivers: evaluation of fixed cases with results as CSV and their mean, rule extraction to several places, a demonstration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import evaluate, graph, questions, responses
from graphloom.sources import files
from graphloom.sources.storage import materialize

from .pipeline import extract_by_rules

# The paths and questions that evaluations go through.
PATH_CASES = (
    ("TSMC", "Broadcom"),
    ("TSMC", "AMD"),
    ("TSMC", "Broadcom", "Huawei"),
    ("UMC", "AMD", "TSMC", "Broadcom", "Huawei"),
    ("UMC", "GLOBALFOUNDRIES", "AMD", "TSMC", "Broadcom", "Huawei"),
)
QUESTION_CASES = (
    ("Q1", "direct", "How could a disruption at TSMC directly affect Broadcom?"),
    ("Q2", "two_hop", "How could a disruption at TSMC affect Huawei through Broadcom?"),
    ("Q3", "multi_hop", "How could a disruption at UMC eventually affect Huawei?"),
    ("Q4", "direction", "Based on the retrieved relationships, why would a disruption at TSMC affect AMD?"),
    ("Q5", "insufficient_evidence", "What exact financial loss would AMD experience from a disruption at TSMC?"),
)
Provider = Callable[[], responses.CompletionProvider]


def path_cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(list(p),) for p in PATH_CASES], "path array<string>")


def question_cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUESTION_CASES), "id string, type string, question string")


def _missing(wanted: DataFrame, found: DataFrame, by: str, name: Column, what: str) -> None:
    """An error that names up to five of `wanted` that `found` lacks."""
    gone = [r[0] for r in wanted.join(found.select(by).distinct(), by, "left_anti").select(name).limit(5).collect()]
    if gone:
        raise ValueError(f"{what}: {'; '.join(gone)}")


def evaluate_path_cases(edge_table: DataFrame, out: str, make: Provider | None = None, cases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The result rows of the cases (column path), written to out as CSV, and their mean score. A path that retrieval doesn't reach
    is an error. Judged by a model, or by rule without one."""
    cases = path_cases(edge_table.sparkSession) if cases is None else cases
    starts = cases.select(F.get("path", F.lit(0)).alias("start"))
    reached = graph.retrieve_evidence(edge_table, starts, questions.MAX_HOPS, questions.MAX_PATHS)
    found = materialize(reached.join(cases.select("path").distinct(), "path", "left_semi"), "path-cases")
    _missing(cases, found, "path", graph.path_text(F.col("path")), "Path not found")
    if make is None:
        judged = evaluate.rule_judge(found)
    else:
        text = found.withColumn("text", evaluate.step_text(F.col("path"), F.col("relationships")))
        judged = evaluate.model_judge(text, "text", evaluate.PATH_ITEMS, ("unsupported_steps", "direction_errors"), make)
    rows = materialize(evaluate.path_rows(judged), "path-results")
    files.write_csv(rows, out)
    return rows, evaluate.mean_score(rows)


def evaluate_question_cases(edge_table: DataFrame, out: str, make_answer: Provider | None = None, make_judge: Provider | None = None, cases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The result rows of the questions (id, type, question), written to out as CSV, and their mean score. Answers and judgements
    come from models, or by rule without one. A question without evidence is an error."""
    cases = question_cases(edge_table.sparkSession) if cases is None else cases
    answers = materialize(questions.answer_by_model(questions.answer_questions(cases, edge_table), make_answer), "answers")
    _missing(cases, answers.filter("status = 'OK'"), "id", F.col("question"), "No relationships were found")
    if make_judge is None:
        rows = evaluate.answer_rows(evaluate.rule_judge_answers(answers))
    else:
        text = F.concat(F.lit("Question: "), "question", F.lit("\n\nEvidence:\n"), "context", F.lit("\n\nAnswer:\n"), "answer")
        rows = evaluate.answer_rows(evaluate.model_judge(answers.withColumn("text", text), "text", evaluate.ANSWER_ITEMS, ("unsupported_claims", "direction_errors"), make_judge))
    rows = materialize(rows, "answer-results")
    files.write_csv(rows, out)
    return rows, evaluate.mean_score(rows)


def rules_to_copies(spark: SparkSession, folder: str, outs: list[str]) -> DataFrame:
    """The rules' triples of all filings of a folder, made once and written to each of outs."""
    found = materialize(extract_by_rules(files.filings(spark, folder)).drop("ord"), "rule-triples")
    files.write_copies(found, outs, lambda df, path: df.write.mode("overwrite").parquet(path))
    return found


def demonstration(edge_table: DataFrame, start: str | DataFrame = "TSMC", max_hops: int = 2, max_paths: int = 10) -> DataFrame:
    """start, rank and the text of each retrieved path: its companies, then its relations with direction, source and sentence."""

    def relation(r: Column) -> Column:
        edge = F.concat(r["head"], F.lit(" --"), r["relation"], F.lit("--> "), r["tail"])
        return F.concat_ws("\n", edge, F.concat(F.lit("Traversal: "), r["traversal_direction"]), F.concat(F.lit("Source: "), F.coalesce(r["source_file"], F.lit("None"))), F.concat(F.lit("Evidence: "), F.coalesce(r["source_sentence"], F.lit("None"))))

    found = graph.retrieve_evidence(edge_table, start, max_hops, max_paths)
    return found.select("start", "rank", F.concat_ws("\n", F.lit("Cascade path:"), graph.path_text(F.col("path")), F.array_join(F.transform("relationships", relation), "\n")).alias("text"))
