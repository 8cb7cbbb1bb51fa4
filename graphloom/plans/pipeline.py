"""The stages end to end, and a command line: python -m graphloom.plans.pipeline --filings DIR --out DIR."""

from __future__ import annotations

import argparse
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.functions.lexicon import FILERS, Lexicon
from graphloom.operators import annotate, evaluate, graph, layout, merge, questions, reports, responses, rules
from graphloom.operators.resolve import filer_table, with_filer
from graphloom.sources import files
from graphloom.sources.storage import materialize
from graphloom.sources.store import BucketStore
from graphloom.streaming import incremental


def extract_by_rules(filings: DataFrame, make: Callable[[], annotate.Annotator] = annotate.PlainAnnotator) -> DataFrame:
    """Triples that the rules find in all filings."""
    names = filer_table(filings.sparkSession, {t: n[0] for t, n in FILERS.items()})
    sents = text.sentences(filings).filter(text.fits_rules(F.col("sentence")))
    return rules.extract(with_filer(annotate.annotate(sents, make), names))


def extract_by_model(filings: DataFrame, make: Callable[[], responses.CompletionProvider] | None, cap: int = 100, answers: str | None = None, scope: str = "") -> tuple[DataFrame, DataFrame]:
    """Triples and errors from a model asked about the first `cap` relevant sentences of each file. Both come from the same answers,
    which the ledger under `answers` keeps for later runs; scope names the model."""
    names = filer_table(filings.sparkSession, {t: n[0] for t, n in FILERS.items()})
    sents = text.sentences(filings).filter(text.fits_model(F.col("sentence")) & text.is_relevant(F.col("sentence")))
    asked = responses.prompts(with_filer(text.first_sentences(sents, cap), names))
    parsed = responses.parse(responses.complete(asked, make, answers, scope=scope))
    return responses.triples(parsed), responses.errors(parsed)


def edges_of(merged: DataFrame) -> DataFrame:
    """The graph of merged triples. Edges are numbered in the triples' order."""
    return graph.edges(merge.placed(merged, "edge_ord", [F.col("confidence").desc(), F.col("head"), F.col("relation"), F.col("tail")]))


def evaluate_paths(edge_table: DataFrame, paths: DataFrame, max_hops: int = 5, max_paths: int = 25) -> DataFrame:
    """Result rows of the given paths (column path), judged by rule; paths that retrieval doesn't reach are left out."""
    found = graph.retrieve_evidence(edge_table, paths.select(F.get("path", F.lit(0)).alias("start")), max_hops, max_paths)
    return evaluate.path_rows(evaluate.rule_judge(found.join(paths.select("path").distinct(), "path", "left_semi")))


def evaluate_answers(answers: DataFrame, make: Callable[[], responses.CompletionProvider]) -> DataFrame:
    """Result rows of answered questions (with type), judged by a model from question, context and answer."""
    text_ = F.concat(F.lit("Question: "), "question", F.lit("\n\nEvidence:\n"), "context", F.lit("\n\nAnswer:\n"), "answer")
    good = answers.filter("status = 'OK'").withColumn("text", text_)
    return evaluate.answer_rows(evaluate.model_judge(good, "text", evaluate.ANSWER_ITEMS, ("unsupported_claims", "direction_errors"), make))


EXTRACTORS = (("rule_based", "rule_triples"), ("model", "model_triples"))


def merged_store(spark: SparkSession, out: str) -> BucketStore:
    return BucketStore(spark, f"{out}/state", merge.KEY)


def keep_up(spark: SparkSession, out: str, done: DataFrame, lexicon: Lexicon, batch: int | None = None) -> None:
    """Adds the triples of the files in done (source_file) to the merged state under out: only they are resolved and judged."""
    parts = [(name, files.stored_triples(spark, f"{out}/{at}").join(done, "source_file", "left_semi")) for name, at in EXTRACTORS]
    merged_store(spark, out).merge(merge.state_rows(merge.judge(merge.union_extractors(parts), lexicon)), merge.combine, batch)


def extract_new(spark: SparkSession, folder: str, out: str, make_provider=None, cap: int = 100, scope: str = "", lexicon: Lexicon | None = None) -> None:
    """Extracts from the files that came since the last call, replaces only their rows under out and adds their triples to the merged
    state. A file without triples is not taken again; a batch that comes again changes nothing."""

    def work(read: DataFrame, batch: int) -> None:
        read = materialize(read, "new-filings")
        done = read.select("source_file")
        files.write_by_file(extract_by_rules(read), f"{out}/rule_triples", done, batch)
        found, errors = extract_by_model(read, make_provider, cap, f"{out}/answers", scope)
        files.write_by_file(found, f"{out}/model_triples", done, batch)
        files.write_errors(errors, f"{out}/errors", done, batch)
        keep_up(read.sparkSession, out, done, lexicon or Lexicon(), batch)

    incremental.process_new(spark, folder, f"{out}/checkpoint", work)


def run(spark: SparkSession, folder: str, out: str, *, make_provider=None, make_annotator=annotate.PlainAnnotator, cap: int = 100, lexicon: Lexicon | None = None, scope: str = "") -> dict[str, DataFrame]:
    """All stages; each result is written under out before the next one reads it. A model's answers stay under out for later runs,
    which ask only what they lack."""
    lexicon = lexicon or Lexicon()
    read = files.filings(spark, folder)
    files.triple_store(spark, f"{out}/rule_triples").replace_all(extract_by_rules(read, make_annotator))
    asked, errors = extract_by_model(read, make_provider, cap, f"{out}/answers", scope)
    files.triple_store(spark, f"{out}/model_triples").replace_all(asked)
    files.write_errors(errors, f"{out}/errors", read.select("source_file"))
    parts = [(name, files.stored_triples(spark, f"{out}/{at}")) for name, at in EXTRACTORS]
    merged_store(spark, out).replace_all(merge.state_rows(merge.judge(merge.union_extractors(parts), lexicon)))
    return merged_results(spark, folder, out, lexicon)


def merged_results(spark: SparkSession, folder: str, out: str, lexicon: Lexicon | None = None) -> dict[str, DataFrame]:
    """What follows extraction, from the merged state under out, without a look at all triples again. The JSON document is an
    export: all triples meet in one row of it."""
    lexicon = lexicon or Lexicon()
    state = merged_store(spark, out)
    merged = merge.sorted_triples(state.read()) if state.schema else merge.merge([(n, files.stored_triples(spark, f"{out}/{at}")) for n, at in EXTRACTORS], lexicon)
    merged.write.mode("overwrite").parquet(f"{out}/merged")
    merged = spark.read.parquet(f"{out}/merged")
    files.write_envelope(merged, f"{out}/merged_json", [(-F.col("confidence")).alias("c"), "head", "relation", "tail"])
    edge_table = edges_of(merged)
    return {"merged": merged, "edges": edge_table, "relations": reports.relation_counts(merged), "companies": reports.companies(merged, lexicon), "per_file": reports.per_file(files.filings(spark, folder), files.stored_triples(spark, f"{out}/rule_triples"))}


def ask(spark: SparkSession, edge_table: DataFrame, question: str, make_provider=None) -> tuple[DataFrame, str]:
    """The answer row to one question, by a model if there is one, and a picture of its paths."""
    if not question.strip():
        raise ValueError("A question is required")
    asked = spark.createDataFrame([(1, question.strip())], "id int, question string")
    answer = questions.answer_by_model(questions.answer_questions(asked, edge_table), make_provider)
    row = answer.first()
    if row["status"] != "OK":
        return answer, ""
    paths = graph.first_paths(graph.cascade_paths(edge_table, row["start"], limit=questions.MAX_PATHS), questions.MAX_PATHS)
    if row["target"]:
        paths = graph.to_target(paths, row["target"])
    chosen = questions.deepest(paths, by="start")
    return answer, layout.svg(layout.styled(layout.positions(chosen), row["target"]), layout.path_edges(chosen), row["start"])


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--filings", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--max-sentences", type=int, default=100)
    parser.add_argument("--question")
    parser.add_argument("--picture", help="a file for an SVG picture of the paths that answer the question")
    parser.add_argument("--new-only", action="store_true", help="extract only from filings that came since the last run; a crash loses no file that was done")
    parser.add_argument("--skip-model", action="store_true")
    parser.add_argument("--model-url", help="an endpoint for chat messages; the key comes from MODEL_API_KEY")
    parser.add_argument("--model", default="")
    args = parser.parse_args()
    spark = SparkSession.builder.getOrCreate()
    key = os.environ.get("MODEL_API_KEY", "")
    asked = bool(args.model_url and key) and not args.skip_model
    make = (lambda: responses.HttpProvider(args.model_url, key, args.model)) if asked else None
    if args.new_only:
        extract_new(spark, args.filings, args.out, make, args.max_sentences, args.model)
        found = merged_results(spark, args.filings, args.out)
    else:
        found = run(spark, args.filings, args.out, make_provider=make, cap=args.max_sentences, scope=args.model)
    found["relations"].show(truncate=False)
    found["companies"].show(1000, truncate=False)
    if args.question:
        answer, picture = ask(spark, found["edges"], args.question, make)
        if args.picture and picture:
            with open(args.picture, "w", encoding="utf-8") as file:
                file.write(picture)
        answer.select("status", "start", "target", "max_depth", "answer").show(truncate=False)


if __name__ == "__main__":
    main()
