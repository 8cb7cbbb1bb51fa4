"""From questions to grounded contexts: entity linking, path choice, rendering, answers. All questions go through at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.storage import materialize

from .graph import cascade_paths, first_paths, nodes, path_evidence, path_text, paths_to
from .responses import CompletionProvider, complete
from .spans import occurrences

# Phrases that name what is disrupted, in order; the sizes of a retrieval.
PHRASES = ("disruption in ", "disruption at ", "disruption of ", "disruption to ")
MAX_HOPS, MAX_PATHS, MAX_SELECTED = 5, 25, 3
NO_EVIDENCE = "No relevant supply-chain relationships were found."

RULES = """Use only the evidence below to answer the question about supply-chain risk.
- Name no company and no relation that the evidence lacks; extracted relations may be wrong.
- Keep direct evidence and inference apart, and say so if the evidence is not enough.
- Give the source file of each important claim. Confidence is not a probability.
- One hop is direct; two or more are a multi-hop cascade, which needs evidence for every hop. Use the hop counts given.
- Longer cascades are less certain. supplier_of and customer_of of one pair from one sentence are one relation.
Start with a summary of one or two sentences, name at most 3 distinct paths, join those that share most companies, repeat
nothing, and stay under 250 words of plain language."""


def mentions(questions: DataFrame, node_table: DataFrame) -> DataFrame:
    """(id, name, node_ord, pos) of each node whose name a question holds, as a plain part of its text.

    Names are looked up at every place of a question by length and hash, so questions and nodes meet by an equi-join in which
    short names and common beginnings are no common key.
    """
    asked = questions.select("id", F.lower("question").alias("q"))
    return occurrences(asked, "q", ["id"], node_table.select("name", "node_ord", F.lower("name").alias("low")), "low").drop("low")


def _after_phrases(questions: DataFrame) -> DataFrame:
    low = F.lower("question")
    rows = F.array(*[F.struct(F.lit(i).alias("phrase"), F.when(F.instr(low, F.lit(p)) > 0, F.substring(low, F.instr(low, F.lit(p)) + len(p), F.length(low))).alias("rest")) for i, p in enumerate(PHRASES)])
    return questions.select("id", F.inline(F.filter(rows, lambda r: r["rest"].isNotNull())))


def starts(questions: DataFrame, node_table: DataFrame) -> DataFrame:
    """(id, start): the longest node named right after the first phrase that has one; else the first mention; null if none."""
    n = node_table.select("name", "node_ord", F.lower("name").alias("low"))
    longest = n.agg(F.max(F.length("low")).alias("k")).first()["k"] or 1  # no name is a longer prefix
    sizes = F.array_distinct(F.transform(F.sequence(F.lit(1), F.least(F.length("rest"), F.lit(longest))), lambda k: F.substring(F.col("rest"), F.lit(1), k)))
    after = _after_phrases(questions).filter(F.length("rest") > 0).select("id", "phrase", F.explode(sizes).alias("low")).join(n, "low")
    w = Window.partitionBy("id")
    named = after.withColumn("r", F.row_number().over(w.orderBy("phrase", F.length("name").desc(), "node_ord"))).filter("r = 1").select("id", F.col("name").alias("named"))
    first = mentions(questions, node_table).withColumn("r", F.row_number().over(w.orderBy("pos", "node_ord"))).filter("r = 1").select("id", F.col("name").alias("first"))
    return questions.select("id").join(named, "id", "left").join(first, "id", "left").select("id", F.coalesce("named", "first").alias("start"))


def mention_lists(questions: DataFrame, node_table: DataFrame) -> DataFrame:
    """(id, companies): all mentioned nodes by position."""
    rows = mentions(questions, node_table).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_ord", "name"))).alias("found"))
    return questions.select("id").join(rows, "id", "left").select("id", F.coalesce(F.transform("found", lambda x: x["name"]), F.array().cast("array<string>")).alias("companies"))


def link(questions: DataFrame, node_table: DataFrame) -> DataFrame:
    """questions with start, companies and target (the first mentioned that isn't the start, or null)."""
    both = questions.join(starts(questions, node_table), "id").join(mention_lists(questions, node_table), "id")
    return both.withColumn("target", F.get(F.filter("companies", lambda c: c != F.col("start")), F.lit(0)))


def deepest(evidence: DataFrame, limit: int = MAX_SELECTED, by: str = "id") -> DataFrame:
    """The longest paths of each question, in breadth-first order among equals; select_rank counts from 1."""
    w = Window.partitionBy(by).orderBy(F.size("path").desc(), "rank")
    return evidence.withColumn("select_rank", F.row_number().over(w)).filter(F.col("select_rank") <= limit)


def render_path(number: Column, path: Column, relationships: Column) -> Column:
    """One path of a context. Sentences are cut after 500 characters."""

    def one(r: Column, i: Column) -> Column:
        sure = F.when(r["confidence"].isNull(), "not provided").otherwise(F.format_string("%.2f", r["confidence"]))
        said = F.coalesce(r["source_sentence"], F.lit(""))
        said = F.when(F.length(said) > 500, F.concat(F.substring(said, 1, 500), F.lit("..."))).otherwise(said)
        edge = F.concat(r["head"], F.lit(" --"), r["relation"], F.lit("--> "), r["tail"])
        return F.concat_ws("\n", F.format_string("Relationship %d:", i + 1), edge, F.concat(F.lit("Confidence: "), sure), F.concat(F.lit("Source: "), F.coalesce(r["source_file"], F.lit("None"))), F.concat(F.lit("Evidence: "), said), F.lit(""))

    head = F.concat_ws("\n", F.format_string("PATH %d", number), F.concat(F.lit("Graph path: "), path_text(path)), F.format_string("Hop count: %d", F.size(path) - 1), F.lit(""))
    return F.concat_ws("\n", head, F.array_join(F.transform(relationships, one), "\n"))


def contexts(selected: DataFrame, by: str = "id") -> DataFrame:
    """(id, context): the selected paths of each question, numbered."""
    text = render_path(F.col("select_rank"), F.col("path"), F.coalesce("relationships", F.array()))
    rows = selected.select(by, "select_rank", text.alias("text")).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("select_rank", "text"))).alias("texts"))
    return rows.select(by, F.array_join(F.transform("texts", lambda t: t["text"]), "\n\n").alias("context"))


def prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit(RULES + "\n\nQuestion:\n"), question, F.lit("\n\nEvidence:\n"), context, F.lit("\n\nAnswer:"))


def plain_answer(start: Column, target: Column, depth: Column, n: Column) -> Column:
    """An answer without a model: what was found."""
    return F.format_string("Disruption at %s reaches %s on %d path(s) of up to %d hop(s); see the evidence.", start, F.coalesce(target, F.lit("others")), n, depth)


def answer_questions(questions: DataFrame, edge_table: DataFrame, *, max_hops: int = MAX_HOPS, max_paths: int = MAX_PATHS, max_selected: int = MAX_SELECTED, target_first: bool = False) -> DataFrame:
    """Each question (id, question, more) with start, target, status, max_depth, selected_paths, context, prompt and answer.

    status is OK, NO_COMPANY (no node is named) or NO_PATH. The target is applied after the limit of max_paths, unless
    target_first: then paths elsewhere use up no place.
    """
    linked = materialize(link(questions, nodes(edge_table)), "linked")
    known = linked.filter(F.col("start").isNotNull()).select("id", "start", "target")
    aimless = known.filter(F.col("target").isNull()) if target_first else known
    paths = cascade_paths(edge_table, aimless.select("start"), max_hops, max_paths)
    hits = F.col("target").isNull() | (F.element_at("path", -1) == F.col("target"))
    chosen = aimless.join(first_paths(paths, max_paths), "start").filter(hits)
    if target_first:
        w = Window.partitionBy("start", "target").orderBy("hops", "path")
        aimed = paths_to(edge_table, known.select("start", "target"), max_hops, max_paths).withColumn("rank", F.row_number().over(w))
        chosen = chosen.unionByName(known.join(aimed, ["start", "target"]), allowMissingColumns=True)
    chosen = materialize(chosen, "chosen")
    depth = chosen.groupBy("id").agg(F.max("hops").alias("max_depth"), F.count("*").alias("paths"))
    selected = deepest(chosen, max_selected)
    evidence = path_evidence(selected.select("start", "path").distinct(), edge_table)
    text = contexts(selected.join(evidence, ["start", "path"]))
    counts = selected.groupBy("id").agg(F.count("*").alias("selected_paths"))
    out = linked.join(depth, "id", "left").join(counts, "id", "left").join(text, "id", "left")
    status = F.when(F.col("start").isNull(), "NO_COMPANY").when(F.col("paths").isNull(), "NO_PATH").otherwise("OK")
    out = out.withColumn("status", status).withColumn("context", F.coalesce("context", F.lit(NO_EVIDENCE)))
    out = out.withColumn("prompt", F.when(status == "OK", prompt(F.col("question"), F.col("context"))))
    return out.withColumn("answer", F.when(status == "OK", plain_answer(F.col("start"), F.col("target"), F.col("max_depth"), F.col("paths")))).drop("paths")


def answer_by_model(answers: DataFrame, make: Callable[[], CompletionProvider] | None, callers: int = 1) -> DataFrame:
    """answers of answer_questions() with a model's answer to each prompt; the plain answer stays where there is no prompt, where
    the model fails (its error is then in answer_error), or without a provider."""
    if make is None:
        return answers.withColumn("answer_error", F.lit(None).cast("string"))
    asked = materialize(answers, "asked")
    said = complete(asked.filter(F.col("prompt").isNotNull()).select("id", "prompt"), make, callers=callers).select("id", "response", F.col("error").alias("answer_error"))
    both = asked.join(said, "id", "left")
    good = F.col("answer_error").isNull() & (F.trim("response") != "")
    return both.withColumn("answer", F.when(good, F.trim("response")).otherwise(F.col("answer"))).drop("response")
