"""Queries that go through files, drivers and stages: texts made of the given tables are written, extracted from, merged and judged."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import annotate, evaluate, graph, merge, questions, reports, resolve, responses
from graphloom.sources import files
from graphloom.sources.storage import materialize, new_folder

from . import drivers, pipeline
from .catalog import _GAPS, _JUDGED, _PATHS, _Q, _RESPONSES, _SENTENCES, _answers, _edges, _gaps, _parsed, _top, filings, query
from .views import LEXICON, VIEWS, tables, view, with_views

#: Sentences that state the trade between nations, one after another in a file for each nation.
LINES = """
SELECT concat(replace(src, 'NATION_', 'N'), '_2023.txt') AS source_file, CAST(i AS INT) AS line, concat('In most years ', src, ' supplies wafers to ', dst, ' and others at home') AS said, src AS head, 'supplier_of' AS relation, dst AS tail, 0.75 AS confidence FROM trade
UNION ALL
SELECT concat(replace(dst, 'NATION_', 'N'), '_2023.txt'), CAST(1000 + i AS INT), concat('At all times ', dst, ' depends on ', src, ' for most of its wafers'), dst, 'depends_on', src, 0.78 FROM need
"""
#: Sentences for a model, of the largest customers of each nation; some of its answers are no JSON.
TOLD = """
SELECT concat(replace(src, 'NATION_', 'N'), '_2023.txt') AS source_file, CAST(i AS INT) AS line, concat('Since then ', dst, ' is a customer of ', src, ' for wafers and much more of it') AS said, dst AS head, src AS tail FROM trade
"""


def _lines(spark, sf_dir, sql: str) -> DataFrame:
    tables(spark, sf_dir, "nation", "customer", "supplier", "orders", "lineitem")
    materialize(spark.sql(VIEWS["flow"]), "flow").createOrReplaceTempView("flow")
    for name in ("trade", "need"):
        spark.sql(VIEWS[name]).createOrReplaceTempView(name)
    return spark.sql(sql)


def _filings(lines: DataFrame) -> DataFrame:
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "said"))), lambda x: x["said"]), ". ")
    return lines.groupBy("source_file").agg(F.concat(said, F.lit(".")).alias("text"))


def _folder_of(lines: DataFrame) -> str:
    folder = new_folder(lines.sparkSession, "filings")
    files.write_filings(_filings(lines), folder)
    return folder


_LINES = f"{with_views('flow', 'trade', 'need')}, lines AS ({LINES})"
_OF_LINES = _JUDGED.replace(f"raw AS ({VIEWS['raw']})", f"need AS ({VIEWS['need']}), lines AS ({LINES}), raw AS (SELECT 'rule_based' AS extractor, 0 AS extractor_ord, line AS ord, head, relation, tail, CAST(confidence AS DOUBLE) AS confidence, source_file, said AS source_sentence FROM lines)")


@query(f"WITH {_LINES} SELECT source_file, md5(string_agg(said, '. ' ORDER BY line) || '.') AS digest FROM lines GROUP BY source_file")
def q_filings_read(spark, sf_dir):
    """Files written and read whole."""
    return files.filings(spark, _folder_of(_lines(spark, sf_dir, LINES))).select("source_file", F.md5("text").alias("digest"))


@query(f"WITH {_LINES} SELECT head, relation, tail, CAST(confidence AS DOUBLE) AS confidence, source_file, md5(CASE WHEN row_number() OVER (PARTITION BY source_file ORDER BY line DESC) = 1 THEN said || '.' ELSE said END) AS digest FROM lines")
def q_rules_on_files(spark, sf_dir):
    """Files to triples by the plain annotator and the rules."""
    found = pipeline.extract_by_rules(files.filings(spark, _folder_of(_lines(spark, sf_dir, LINES))))
    return found.select("head", "relation", "tail", "confidence", "source_file", F.md5("source_sentence").alias("digest"))


_WORD = r"[\p{L}\p{N}_]"
_FORMS = ", ".join(f"'{w}'" for w in annotate.trigger_forms())


@query(rf"""{_SENTENCES}, kept AS (SELECT * FROM sentences WHERE length(sentence) BETWEEN 30 AND 800 AND list_has_any(regexp_split_to_array(lower(sentence), '[^a-z]+'), [{_FORMS}])),
found AS (SELECT source_file, sent_pos, regexp_extract_all(sentence, '\s*({_WORD}+(''{_WORD}+)?|[^\p{{L}}\p{{N}}_\s])') AS pieces FROM kept), pieces AS (SELECT source_file, sent_pos, unnest(pieces) AS piece, unnest(range(len(pieces))) AS i FROM found),
placed AS (SELECT *, trim(piece) AS text, sum(length(piece)) OVER (PARTITION BY source_file, sent_pos ORDER BY i) - length(trim(piece)) AS idx FROM pieces)
SELECT source_file, sent_pos, count(*) AS n, md5(string_agg(i || ' ' || idx || ' ' || text, ' ' ORDER BY i)) AS digest FROM placed GROUP BY source_file, sent_pos""")
def q_annotate_tokens(spark, sf_dir):
    """The plain annotator's tokens, with their places, of all sentences of all documents that may hold a trigger."""
    found = annotate.annotate(text.sentences(filings(spark, sf_dir)).filter(text.fits_rules(F.col("sentence"))))
    listed = F.array_join(F.transform("tokens", lambda t: F.concat_ws(" ", t["i"], t["idx"], t["text"])), " ")
    return found.select("source_file", "sent_pos", F.size("tokens").cast("long").alias("n"), F.md5(listed).alias("digest"))


@query(f"{_OF_LINES} SELECT head, relation, tail, confidence, source_file, extractor FROM merged WHERE k = 1")
def q_pipeline_merged(spark, sf_dir):
    """All stages over a folder of files, to the merged triples."""
    found = pipeline.run(spark, _folder_of(_lines(spark, sf_dir, LINES)), new_folder(spark, "out"), lexicon=LEXICON)
    return found["merged"].select("head", "relation", "tail", "confidence", "source_file", "extractor")


@query(f"{_OF_LINES} SELECT relation, count(*) AS n FROM merged WHERE k = 1 GROUP BY relation")
def q_pipeline_new_files(spark, sf_dir):
    """The same from files that come in two parts, by the stream of new files and the state that it keeps up."""
    lines = _filings(_lines(spark, sf_dir, LINES))
    folder, out = new_folder(spark, "filings"), new_folder(spark, "out")
    first = F.pmod(F.crc32(F.col("source_file").cast("binary")), F.lit(2)) == 0
    for some in (lines.filter(first), lines.filter(~first)):
        files.write_filings(some, folder)
        pipeline.extract_new(spark, folder, out, lexicon=LEXICON)
    return reports.relation_counts(pipeline.merged_results(spark, folder, out, LEXICON)["merged"]).select("relation", "n")


def _told(prompt: str) -> str:
    head, tail = re.search(r"(NATION_\d+) is a customer of (NATION_\d+)", prompt).groups()
    if head.endswith("3"):
        return "Sorry, no."
    return json.dumps({"triples": [{"head": head, "relation": "customer_of", "tail": tail, "confidence": 0.9}]})


@query(f"WITH {with_views('flow', 'trade')}, told AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY line) AS k FROM ({TOLD}) t) SELECT source_file, 'supplier_of' AS relation, tail AS head, head AS tail, CASE WHEN ends_with(head, '3') THEN 1 ELSE 0 END AS failed FROM told WHERE k <= 1")
def q_model_on_files(spark, sf_dir):
    """The first relevant sentence of each file through a model, its triples and, with what was asked, its errors."""
    read = files.filings(spark, _folder_of(_lines(spark, sf_dir, TOLD)))
    found, errors = pipeline.extract_by_model(read, lambda: _told, cap=1)
    names = [F.regexp_extract("sentence", r"(NATION_\d+) is a customer of (NATION_\d+)", k) for k in (1, 2)]
    failed = errors.select("source_file", F.lit("supplier_of").alias("relation"), names[1].alias("head"), names[0].alias("tail"), F.lit(1).alias("failed"))
    return found.select("source_file", "relation", "head", "tail", F.lit(0).alias("failed")).unionByName(failed)


@query(f"WITH {with_views('raw')} SELECT (row_number() OVER (ORDER BY extractor_ord, ord) - 1)::INT AS ord, head, relation, tail, confidence, source_file, source_sentence, extractor FROM raw")
def q_triple_files(spark, sf_dir):
    """A document of triples, written and read back in its order."""
    folder = new_folder(spark, "triples")
    files.write_envelope(view(spark, sf_dir, "raw"), folder, ["extractor_ord", "ord"])
    return files.triples(spark, folder).select("ord", "head", "relation", "tail", "confidence", "source_file", "source_sentence", "extractor")


@query(f"{_RESPONSES} SELECT source_file, count(*) AS n, count(DISTINCT sentence) AS sentences FROM cleaned WHERE NOT json_valid(body) GROUP BY source_file")
def q_error_files(spark, sf_dir):
    """Errors of files in three batches, one of which comes twice: none is lost and none is there twice."""
    errors, folder = responses.errors(_parsed(spark, sf_dir)), new_folder(spark, "errors")
    part = F.pmod(F.crc32(F.col("source_file").cast("binary")), F.lit(3))
    for batch, k in enumerate((1, 0, 1, 2)):
        some = errors.filter(part == k)
        files.write_errors(some, folder, some.select("source_file"), batch)
    return files.error_store(spark, folder).read().groupBy("source_file").agg(F.count("*").alias("n"), F.countDistinct("sentence").alias("sentences"))


@query(f"WITH {with_views('raw')} SELECT place, extractor, count(*) AS n, sum(coalesce(confidence, 0))::DECIMAL(18, 4)::DOUBLE AS sure FROM raw, (VALUES ('a'), ('b')) p(place) GROUP BY place, extractor")
def q_copies(spark, sf_dir):
    """The same rows at two places."""
    folder = new_folder(spark, "copies")
    files.write_copies(view(spark, sf_dir, "raw"), [f"{folder}/place=a", f"{folder}/place=b"], lambda df, path: df.write.parquet(path))
    found = spark.read.parquet(folder).groupBy("place", "extractor")
    return found.agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("confidence", F.lit(0.0))), 4).alias("sure"))


@query(f"{_GAPS} SELECT array_to_string(path, ' -> ') AS path, hop_count::INT AS hop_count, 2 * b + 2 * c + 2 AS total_score, unsupported_steps FROM score")
def q_result_files(spark, sf_dir):
    """Result rows as CSV with a header, written and read back."""
    folder, rows = new_folder(spark, "results"), evaluate.path_rows(_gaps(spark, sf_dir))
    files.write_csv(rows, folder)
    kind = ", ".join(f"{c} {'int' if c in ('hop_count', 'total_score', *evaluate.PATH_ITEMS) else 'string'}" for c in rows.columns)
    read = files.read_csv(spark, folder, kind)
    return read.select("path", "hop_count", "total_score", F.coalesce("unsupported_steps", F.lit("")).alias("unsupported_steps"))


@query(f"{_PATHS} SELECT array_to_string(path, ' -> ') AS path, hops AS hop_count, 10 AS total_score FROM top WHERE rank % 5 = 1")
def q_path_cases(spark, sf_dir):
    """Given paths through retrieval and the judge by rule; each of their steps has evidence."""
    edge_table = _edges(spark, sf_dir)
    cases = _top(edge_table).filter("rank % 5 = 1").select("path")
    return drivers.evaluate_path_cases(edge_table, new_folder(spark, "cases"), cases=cases)[0].select("path", "hop_count", "total_score")


def _scores(items: tuple[str, ...], lists: tuple[str, str]):
    """A judge whose scores follow from the number that ends its prompt; one in seven answers is no JSON."""

    def judge(prompt: str) -> str:
        n = int(prompt.rsplit(" ", 1)[1])
        scores = {item: (n + k) % 3 for k, item in enumerate(items)}
        return "none" if n % 7 == 0 else "```json\n" + json.dumps({**scores, lists[0]: [f"a{n}"] * (n % 2), lists[1]: [], "explanation": str(n)}) + "\n```"

    return lambda: judge


_SCORED = "CASE WHEN n % 7 <> 0 THEN (n % 3) + ((n + 1) % 3) + ((n + 2) % 3) + (n % 3) + ((n + 1) % 3) END::INT AS total_score, CASE WHEN n % 7 <> 0 THEN CASE n % 2 WHEN 1 THEN 'a' || n ELSE '' END END AS listed, n % 7 = 0 AS failed"


def _judged_cases(spark, sf_dir, name: str, key: str, items: tuple[str, ...], lists: tuple[str, str]) -> DataFrame:
    cases = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.col(key).cast("long").alias("n")).withColumn("text", F.concat(F.lit("case "), "n"))
    judged = evaluate.model_judge(cases, "text", items, lists, _scores(items, lists))
    return judged.select("n", "total_score", F.when(F.col("error").isNull(), F.array_join(lists[0], "; ")).alias("listed"), F.col("error").isNotNull().alias("failed"))


@query(f"SELECT n, {_SCORED} FROM (SELECT n_nationkey::BIGINT AS n FROM nation) t")
def q_path_judge(spark, sf_dir):
    """A model's judgements of paths: strict JSON, sums, lists, errors."""
    return _judged_cases(spark, sf_dir, "nation", "n_nationkey", evaluate.PATH_ITEMS, ("unsupported_steps", "direction_errors"))


@query(f"SELECT n, {_SCORED} FROM (SELECT r_regionkey::BIGINT AS n FROM region) t")
def q_answer_judge(spark, sf_dir):
    return _judged_cases(spark, sf_dir, "region", "r_regionkey", evaluate.ANSWER_ITEMS, ("unsupported_claims", "direction_errors"))


def _reply(prompt: str) -> str:
    return "Answer to " + prompt.split("Question:\n", 1)[1].split("\n", 1)[0]


@query(f"{_Q} SELECT id, 'Answer to ' || any_value(question) AS answer FROM (SELECT c.id, q.question FROM chosen c JOIN questions q USING (id)) t GROUP BY id")
def q_answers_by_model(spark, sf_dir):
    """Answers of a model to the questions that have evidence."""
    said = questions.answer_by_model(_answers(spark, sf_dir), lambda: _reply)
    return said.filter("status = 'OK'").select("id", "answer")


_RULES = questions.RULES.replace("'", "''")
_CONTEXT = """h AS (SELECT id, k, path, unnest(range(1, len(path))) AS h FROM deep), s AS (SELECT id, k, path, e.*, row_number() OVER (PARTITION BY id, k ORDER BY h, direction, edge_ord) AS place FROM h JOIN evidence e ON e.disrupted = path[h] AND e.impacted = path[h + 1]),
t AS (SELECT id, k, any_value(path) AS path, string_agg('Relationship ' || place || ':' || chr(10) || head || ' --' || relation || '--> ' || tail || chr(10) || 'Confidence: ' || coalesce(printf('%.2f', confidence), 'not provided') || chr(10) || 'Source: ' || source_file || chr(10) || 'Evidence: ' || source_sentence || chr(10), chr(10) ORDER BY place) AS rels FROM s GROUP BY id, k),
c AS (SELECT id, string_agg('PATH ' || k || chr(10) || 'Graph path: ' || array_to_string(path, ' -> ') || chr(10) || 'Hop count: ' || (len(path) - 1) || chr(10) || chr(10) || rels, chr(10) || chr(10) ORDER BY k) AS context FROM t GROUP BY id)"""


@query(f"{_Q}, {_CONTEXT} SELECT q.id, md5('{_RULES}' || chr(10) || chr(10) || 'Question:' || chr(10) || question || chr(10) || chr(10) || 'Evidence:' || chr(10) || context || chr(10) || chr(10) || 'Answer:') AS digest FROM questions q JOIN c USING (id)")
def q_answer_prompts(spark, sf_dir):
    """The whole prompt of each question that has evidence."""
    return _answers(spark, sf_dir).filter("status = 'OK'").select("id", F.md5("prompt").alias("digest"))


@query(f"{_Q}, d AS (SELECT id, max(hops) AS max_depth FROM chosen GROUP BY id) SELECT 1 AS id, start, target, max_depth FROM aimed LEFT JOIN d USING (id) WHERE id = 0")
def q_ask(spark, sf_dir):
    """One question as the command line asks it."""
    asked = view(spark, sf_dir, "questions").filter("id = 0").first()["question"]
    return pipeline.ask(spark, _edges(spark, sf_dir), f"  {asked} ")[0].select("id", "start", "target", "max_depth")


_QUOTED_NAMES = "SELECT n_nationkey AS k, concat('  ', n_name, CASE n_nationkey % 4 WHEN 0 THEN '’s' WHEN 1 THEN '‘s ' WHEN 2 THEN 'ʼs.' ELSE '''s,' END) AS name FROM nation"


@query(rf"WITH n AS ({_QUOTED_NAMES}), p AS (SELECT k, trim(translate(name, '’‘ʼ', '''''''')) AS plain FROM n) SELECT k, CASE WHEN k = 24 THEN NULL ELSE 'NATION_' || regexp_extract(plain, '^NATION_([0-9]+)', 1) END AS entity FROM p")
def q_smart_quotes(spark, sf_dir):
    """Possessives with quotes of all kinds."""
    tables(spark, sf_dir, "nation")
    return resolve.resolve(spark.sql(_QUOTED_NAMES).withColumn("filer", F.lit("")), "name", LEXICON, "entity").select("k", "entity")


@query(f"{_JUDGED} SELECT head, relation, tail, confidence, extractor, source_file FROM merged WHERE k = 1")
def q_merge_whole(spark, sf_dir):
    """Both extractors' triples through the whole merge."""
    raw = view(spark, sf_dir, "raw")
    parts = [(name, raw.filter(F.col("extractor") == name).drop("extractor", "extractor_ord")) for name in ("rules", "model")]
    return merge.merge(parts, LEXICON).select("head", "relation", "tail", "confidence", "extractor", "source_file")
