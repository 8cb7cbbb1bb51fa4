"""Queries over the driver's tables, one for each operator or few, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import lexicon as fixed
from graphloom.functions import text
from graphloom.operators import annotate, asof, evaluate, graph, layout, merge, questions, reports, resolve, responses, rules, spans
from graphloom.operators.resolve import canon_table, filer_table
from graphloom.sources import ledger
from graphloom.sources.storage import materialize, new_folder
from graphloom.sources.store import BucketStore
from graphloom.streaming import incremental

from . import drivers
from .views import LEXICON, tables, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with SQL for the same rows."""

    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return register


# Text preparation. Each document is a filing with a banner in front.

def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "documents")
    return spark.sql("SELECT concat(upper(source), '_', CAST(doc_id AS STRING), '.txt') AS source_file, concat('=== ITEM 1A: Risks ===', text) AS text FROM documents")


_FILINGS = "filings AS (SELECT concat(upper(source), '_', CAST(doc_id AS VARCHAR), '.txt') AS source_file, concat('=== ITEM 1A: Risks ===', text) AS text FROM documents)"
_CLEAN = r"clean AS (SELECT source_file, trim(regexp_replace(regexp_replace(text, '=== ITEM \d+[A-Z]?:.*?===', '', 'g'), '\s+', ' ', 'g')) AS text FROM filings)"
_SPLIT = r"""marked AS (SELECT source_file, regexp_replace(regexp_replace(text, '([a-z0-9"'')])\.\s+([A-Z"])', '\1' || chr(1) || '\2', 'g'), '([a-z0-9"'')])\.\s+([A-Z"])', '\1' || chr(1) || '\2', 'g') AS text FROM clean),
lists AS (SELECT source_file, string_split(text, chr(1)) AS parts FROM marked),
sentences AS (SELECT source_file, CAST(unnest(range(len(parts))) AS INT) AS sent_pos, trim(unnest(parts)) AS sentence FROM lists)"""
_SENTENCES = f"WITH {_FILINGS}, {_CLEAN}, {_SPLIT}"
_RELEVANT = rf"regexp_matches(sentence, '(^|[^\p{{L}}\p{{N}}_])({'|'.join(fixed.RELEVANT)})($|[^\p{{L}}\p{{N}}_])', 'i')"


@query(f"WITH {_FILINGS}, {_CLEAN} SELECT source_file, md5(text) AS digest, length(text)::BIGINT AS n FROM clean")
def q_clean_text(spark, sf_dir):
    clean = text.clean_text(F.col("text"))
    return filings(spark, sf_dir).select("source_file", clean.alias("text")).select("source_file", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"))


@query(f"{_SENTENCES} SELECT source_file, sent_pos, md5(sentence) AS digest FROM sentences")
def q_sentences(spark, sf_dir):
    return text.sentences(filings(spark, sf_dir)).select("source_file", "sent_pos", F.md5("sentence").alias("digest"))


@query(f"{_SENTENCES} SELECT source_file, count(*) FILTER (WHERE length(sentence) BETWEEN 30 AND 800) AS for_rules, count(*) FILTER (WHERE length(sentence) > 40 AND length(sentence) < 600) AS for_model FROM sentences GROUP BY source_file")
def q_len_filters(spark, sf_dir):
    s = F.col("sentence")
    return text.sentences(filings(spark, sf_dir)).groupBy("source_file").agg(F.count_if(text.fits_rules(s)).alias("for_rules"), F.count_if(text.fits_model(s)).alias("for_model"))


@query(f"{_SENTENCES} SELECT source_file, sent_pos FROM sentences WHERE length(sentence) > 40 AND length(sentence) < 600 AND {_RELEVANT}")
def q_relevance(spark, sf_dir):
    s = F.col("sentence")
    return text.sentences(filings(spark, sf_dir)).filter(text.fits_model(s) & text.is_relevant(s)).select("source_file", "sent_pos")


@query(f"{_SENTENCES}, s AS (SELECT source_file, count(*) AS total, count(*) FILTER (WHERE {_RELEVANT}) AS relevant FROM sentences WHERE length(sentence) > 40 AND length(sentence) < 600 GROUP BY source_file) SELECT source_file, total, relevant, round(100.0 * relevant / total, 6)::DOUBLE AS pct, CASE WHEN relevant > 2 THEN '(capped at 2)' ELSE '' END AS capped, least(relevant, 2) AS sending FROM s")
def q_relevance_stats(spark, sf_dir):
    stats = text.relevance_stats(text.sentences(filings(spark, sf_dir)).filter(text.fits_model(F.col("sentence"))), 2)
    return stats.withColumn("pct", F.round("pct", 6)).withColumn("sending", F.col("sending").cast("long"))


@query(f"{_SENTENCES}, r AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY sent_pos) AS k FROM sentences WHERE length(sentence) > 40 AND length(sentence) < 600) SELECT source_file, sent_pos FROM r WHERE k <= 80")
def q_sentence_cap(spark, sf_dir):
    return text.first_sentences(text.sentences(filings(spark, sf_dir)).filter(text.fits_model(F.col("sentence")))).select("source_file", "sent_pos")


@query(f"WITH {_FILINGS} SELECT source_file, split_part(upper(source_file), '_', 1) AS ticker, CASE split_part(upper(source_file), '_', 1) WHEN 'SRC1' THEN 'One' WHEN 'SRC2' THEN 'Two' ELSE 'Unknown Company' END AS filer FROM filings")
def q_filer_lookup(spark, sf_dir):
    found = resolve.with_filer(filings(spark, sf_dir), filer_table(spark, {"SRC1": "One", "SRC2": "Two"}), "Unknown Company")
    return found.select("source_file", text.ticker(F.col("source_file")).alias("ticker"), "filer")


# Extraction by rules, in table form.

@query("SELECT e.event_id, p.event_id AS near_event_id, CAST(p.value AS DOUBLE) AS near_value FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def q_nearest_before(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return asof.nearest(events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), events.filter("event_type = 'view'"), "user_id", "ts", ["event_id", "value"]).select("event_id", "near_event_id", "near_value")


@query("WITH m AS (SELECT e.event_id, e.ts, p.event_id AS hit, p.ts AS hit_ts FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') p ON e.user_id = p.user_id AND e.ts <= p.ts) SELECT event_id, CASE WHEN hit_ts - ts <= INTERVAL 1 DAY THEN hit END AS near_event_id FROM m")
def q_nearest_after(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return asof.nearest(events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), events.filter("event_type = 'view'"), "user_id", "ts", ["event_id"], 86400, True).select("event_id", "near_event_id")


@query("SELECT s.s_suppkey, n.n_name AS inside FROM supplier s JOIN nation n ON s.s_suppkey % 250 >= n.n_nationkey * 10 AND s.s_suppkey % 250 < n.n_nationkey * 10 + 10")
def q_span_contains(spark, sf_dir):
    """Tokens at s_suppkey % 250 in spans of ten positions, one for each nation."""
    spans_ = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("inside"), (F.col("n_nationkey") * 10).alias("start"), (F.col("n_nationkey") * 10 + 10).alias("end"))
    tokens = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", (F.col("s_suppkey") % 250).alias("idx"))
    return spans.containing(tokens, spans_, key=["s_suppkey"], by=[], at="idx", start="start", end="end", order=["start"], take=["inside"]).select("s_suppkey", "inside")


@query(f"WITH {with_views('rule_tokens', 'rule_ents')} SELECT t.sent, t.i, (SELECT e.text FROM rule_ents e WHERE e.sent = t.sent AND e.s <= t.idx AND t.idx < e.e ORDER BY e.k LIMIT 1) AS inside, (SELECT e.k FROM rule_ents e WHERE e.sent = t.sent AND e.s <= t.idx AND t.idx < e.e ORDER BY e.k LIMIT 1) AS k FROM rule_tokens t")
def q_span_join(spark, sf_dir):
    """For each token of each sentence the first entity around it, as rows that meet by sentence and bin."""
    ents = view(spark, sf_dir, "rule_ents").withColumnRenamed("text", "inside")
    found = spans.containing(view(spark, sf_dir, "rule_tokens").select("sent", "i", "idx"), ents, key=["sent", "i"], by=["sent"], at="idx", start="s", end="e", order=["k"], take=["inside", "k"])
    return found.select("sent", "i", "inside", "k")


_TRIGGERS = ", ".join(f"('{w}', '{k}', '{t[0]}', {c})" for t in fixed.TRIGGERS for k, ws, c in (("verb", t[1], t[3]), ("noun", t[2], t[4])) for w in ws)


@query(rf"""WITH trig(lemma, kind, relation, confidence) AS (VALUES {_TRIGGERS}), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS lemma FROM documents),
c AS (SELECT lemma, count(*) AS n FROM w GROUP BY lemma), k AS (SELECT *, CASE WHEN lemma IN (SELECT lemma FROM trig WHERE kind = 'verb') THEN 'verb' WHEN lemma IN (SELECT lemma FROM trig WHERE kind = 'noun') THEN 'noun' END AS kind FROM c)
SELECT k.lemma, k.kind, relation, CAST(confidence AS DOUBLE) AS confidence, n FROM k JOIN trig USING (lemma, kind)""")
def q_trigger_lookup(spark, sf_dir):
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("lemma"))
    counted = words.groupBy("lemma").agg(F.count("*").alias("n"))
    kind = rules.trigger_kind(F.lit("NOUN"), F.col("lemma"), [v for t in fixed.TRIGGERS for v in t[1]], [n for t in fixed.TRIGGERS for n in t[2]])
    found = counted.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    return found.join(rules.trigger_table(spark).withColumnRenamed("trigger", "lemma"), ["lemma", "kind"]).select("lemma", "kind", "relation", "confidence", "n")


@query("SELECT n.n_name, EXISTS (SELECT 1 FROM region r WHERE contains(lower(n.n_name), lower(left(r.r_name, 2))) OR contains(lower(left(r.r_name, 2)), lower(n.n_name))) AS entity FROM nation n")
def q_entity_fuzzy(spark, sf_dir):
    ents = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.lower(F.substring("r_name", 1, 2)).alias("part")).distinct()
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", F.lower("n_name").alias("low"))
    holds = spans.occurrences(names, "low", ["n_name"], ents, "part").select("n_name")
    within = spans.occurrences(ents, "part", ["part"], names, "low").select("n_name")
    return names.join(holds.union(within).distinct().withColumn("entity", F.lit(True)), "n_name", "left").select("n_name", F.coalesce("entity", F.lit(False)).alias("entity"))


def _listed(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_SELF, _SKIP = _listed(fixed.SELF_WORDS), _listed(fixed.SKIP_WORDS)
_ORDERS = ", ".join(f"('{t[0]}', '{p}', {k}, {str(t[5]).lower()})" for t in fixed.TRIGGERS for k, p in enumerate([*t[6], *[q for q in fixed.PREPOSITIONS if q not in t[6]]]))


def _near(before: bool, at: str, window: int) -> str:
    """The text of the nearest entity of x's sentence."""
    gap = f"{at} - e.e" if before else f"e.s - ({at})"
    return f"(SELECT e.text FROM ent e WHERE e.sent = x.sent AND {gap} BETWEEN 0 AND {window} ORDER BY e.label IN ('ORG', 'PRODUCT') DESC, e.k {'DESC' if before else ''} LIMIT 1)"


def _is_entity(name: str, filer: str) -> str:
    return f"coalesce({name} <> '' AND lower({name}) NOT IN ({_SKIP}) AND (coalesce({filer} <> '' AND lower({name}) = lower({filer}), false) OR EXISTS (SELECT 1 FROM ent e WHERE e.sent = x.sent AND (contains(lower(e.text), lower({name})) OR contains(lower({name}), lower(e.text))))), false)"


#: Rules over rows of tokens and entities, by joins; the library works on arrays.
_TOKENS = rf"""WITH {with_views('rule_tokens', 'rule_ents', 'rule_filers')}, ent AS (SELECT sent, k, trim(text) AS text, s, e, label FROM rule_ents WHERE label IN ('ORG', 'GPE', 'PRODUCT') AND length(trim(text)) <= 80 AND NOT regexp_matches(trim(text), '{fixed.JUNK_SPAN}')),
x AS (SELECT t.*, filer, source_file FROM rule_tokens t JOIN rule_filers USING (sent)),
tok AS (SELECT x.*, coalesce((SELECT e.text FROM ent e WHERE e.sent = x.sent AND e.s <= x.idx AND x.idx < e.e ORDER BY e.k LIMIT 1), CASE WHEN lower(x.text) IN ({_SELF}) THEN filer END) AS name,
  {_near(True, 'x.idx', 300)} AS before, {_near(False, 'x.idx + length(x.text)', 300)} AS after_verb, {_near(False, 'x.idx + length(x.text)', 200)} AS after_noun, {_near(False, 'x.idx', 250)} AS near_object, {_near(False, 'x.idx', 200)} AS near_of FROM x)"""
_EXTRACT = rf"""{_TOKENS}, trig(trigger, kind, relation, confidence) AS (VALUES {_TRIGGERS}), orders_of(relation, prep, place, subj_is_head) AS (VALUES {_ORDERS}),
hit AS (SELECT t.*, relation, confidence FROM (SELECT *, CASE WHEN pos IN ('VERB', 'AUX', 'NOUN') AND lower(lemma) IN (SELECT trigger FROM trig WHERE kind = 'verb') THEN 'verb'
  WHEN pos IN ('NOUN', 'PROPN') AND lower(lemma) IN (SELECT trigger FROM trig WHERE kind = 'noun') THEN 'noun' END AS kind FROM tok) t JOIN trig ON trig.trigger = lower(t.lemma) AND trig.kind = t.kind),
doer AS (SELECT h.*, CASE WHEN kind = 'verb' THEN h.i ELSE (SELECT a.i FROM tok a WHERE a.sent = h.sent AND a.i = h.head AND a.pos IN ('VERB', 'AUX')) END AS at FROM hit h),
own AS (SELECT d.sent, d.i, c.name, row_number() OVER (PARTITION BY d.sent, d.i ORDER BY c.i) AS n FROM doer d JOIN tok c ON c.sent = d.sent AND c.head = d.at AND c.i < d.at AND c.dep IN ('nsubj', 'nsubjpass', 'csubj')),
theirs AS (SELECT d.sent, d.i, c.name, row_number() OVER (PARTITION BY d.sent, d.i ORDER BY c.i) AS n FROM doer d JOIN tok g ON g.sent = d.sent AND g.i = d.at JOIN tok c ON c.sent = d.sent AND g.head <> g.i AND c.head = g.head AND c.i < g.head AND c.dep IN ('nsubj', 'nsubjpass')),
under AS (SELECT h.sent, h.i, h.kind, o.place, p.i AS p, g.i AS g, g.name, g.near_object, g.near_of FROM hit h JOIN tok p ON p.sent = h.sent AND p.head = h.i AND p.i > h.i AND p.dep = 'prep'
  JOIN orders_of o ON o.relation = h.relation AND o.prep = lower(p.lemma) AND (h.kind = 'verb' OR o.prep = 'of') JOIN tok g ON g.sent = h.sent AND g.head = p.i AND g.i > p.i AND g.dep IN ('pobj', 'nmod')),
candidate AS (SELECT h.sent, h.i, -1 AS place, c.i AS p, 0 AS g, 0 AS part, 0 AS q, c.name FROM hit h JOIN tok c ON c.sent = h.sent AND c.head = h.i AND c.i > h.i AND c.dep IN ('dobj', 'attr') WHERE h.kind = 'verb'
  UNION ALL SELECT sent, i, place, p, g, 0, 0, name FROM under
  UNION ALL SELECT u.sent, u.i, place, p, g, 1, c.i, c.name FROM under u JOIN tok c ON c.sent = u.sent AND c.head = u.g AND c.i > u.g AND c.dep IN ('appos', 'conj')
  UNION ALL SELECT sent, i, place, p, g, 2, 0, CASE WHEN kind = 'verb' THEN near_object ELSE near_of END FROM under),
object AS (SELECT sent, i, name, row_number() OVER (PARTITION BY sent, i ORDER BY place, p, g, part, q) AS n FROM candidate WHERE name <> ''),
pair AS (SELECT d.*, (SELECT any_value(subj_is_head) FROM orders_of r WHERE r.relation = d.relation) AS forward,
  coalesce(nullif(CASE WHEN w.n IS NOT NULL THEN w.name ELSE t.name END, ''), nullif(before, ''), nullif(filer, '')) AS subj, coalesce(o.name, nullif(CASE WHEN kind = 'verb' THEN after_verb ELSE after_noun END, '')) AS obj,
  filer <> '' AND (d.dep = 'dobj' OR EXISTS (SELECT 1 FROM tok c WHERE c.sent = d.sent AND c.head = d.i AND c.i < d.i AND c.dep IN ('poss', 'det') AND lower(c.text) IN ({_SELF}))) AS possessed
  FROM doer d LEFT JOIN own w ON w.sent = d.sent AND w.i = d.i AND w.n = 1 LEFT JOIN theirs t ON t.sent = d.sent AND t.i = d.i AND t.n = 1 LEFT JOIN object o ON o.sent = d.sent AND o.i = d.i AND o.n = 1),
turned AS (SELECT x.*, kind = 'noun' AND coalesce(possessed, false) AND relation IN ('supplier_of', 'customer_of') AND {_is_entity('obj', 'NULL')} AS swap, kind = 'verb' AND NOT forward AS turn FROM pair x
  WHERE subj <> obj AND lower(subj) NOT IN ({_SKIP}) AND lower(obj) NOT IN ({_SKIP}) AND ({_is_entity('subj', 'filer')} OR {_is_entity('obj', 'filer')})),
found AS (SELECT *, CASE WHEN swap OR turn THEN obj ELSE subj END AS h, CASE WHEN swap THEN filer WHEN turn THEN subj ELSE obj END AS t FROM turned),
once AS (SELECT *, row_number() OVER (PARTITION BY source_file, sent, h, relation, t ORDER BY i) AS n FROM found)
SELECT CASE WHEN relation = 'customer_of' THEN t ELSE h END AS head, CASE WHEN relation = 'customer_of' THEN 'supplier_of' ELSE relation END AS relation, CASE WHEN relation = 'customer_of' THEN h ELSE t END AS tail,
  CAST(confidence AS DOUBLE) AS confidence, source_file, sent AS sent_pos, i AS pos FROM once WHERE n = 1"""


def _parsed_sentences(spark, sf_dir):
    """The rows of the views rule_tokens and rule_ents as annotated sentences."""
    tokens, ents = view(spark, sf_dir, "rule_tokens"), view(spark, sf_dir, "rule_ents")
    of_tokens = tokens.groupBy("sent").agg(F.sort_array(F.collect_list(F.struct("i", "idx", "text", "lemma", "pos", "dep", "head"))).alias("tokens"))
    listed = ents.groupBy("sent").agg(F.sort_array(F.collect_list(F.struct("k", "text", "s", "e", "label"))).alias("listed"))
    of_ents = listed.select("sent", F.transform("listed", lambda e: F.struct(e["text"].alias("text"), e["s"].alias("start"), e["e"].alias("end"), e["label"].alias("label"))).alias("ents"))
    both = view(spark, sf_dir, "rule_filers").join(of_tokens, "sent").join(of_ents, "sent")
    return both.select("source_file", F.col("sent").alias("sent_pos"), F.lit("").alias("sentence"), "tokens", "ents", "filer")


@query(_EXTRACT)
def q_rule_extract(spark, sf_dir):
    """All rules on a parsed sentence for each customer, in all shapes: what annotations give, without an annotator."""
    found = rules.extract(_parsed_sentences(spark, sf_dir))
    return found.select("head", "relation", "tail", "confidence", "source_file", F.col("ord.sent_pos").alias("sent_pos"), F.col("ord.pos").alias("pos"))


@query(rf"{_TOKENS} SELECT sent AS sent_pos, i AS pos, name, before, after_noun, near_object, {_is_entity('x.text', 'x.filer')} AS entity FROM tok x")
def q_span_nearest(spark, sf_dir):
    """For each token: the entity it stands in, the nearest ones before and after it, and whether its text is one itself."""
    rows = _parsed_sentences(spark, sf_dir).withColumn("ents", rules.entity_filter(F.col("ents"))).select("*", F.explode("tokens").alias("token"))
    token, ents, filer = F.col("token"), F.col("ents"), F.col("filer")
    near = {"before": rules.nearest_before(ents, token["idx"]), "after_noun": rules.nearest_after(ents, token["idx"] + F.length(token["text"]), 200), "near_object": rules.nearest_after(ents, token["idx"], 250)}
    return rows.select("sent_pos", token["i"].alias("pos"), rules.token_entity(token, ents, filer).alias("name"), *[c.alias(k) for k, c in near.items()], rules.is_entity(token["text"], ents, filer).alias("entity"))


@query(f"WITH {with_views('raw')} SELECT extractor, ord, CASE WHEN relation = 'customer_of' THEN tail ELSE head END AS head, CASE WHEN relation = 'customer_of' THEN 'supplier_of' ELSE relation END AS relation, CASE WHEN relation = 'customer_of' THEN head ELSE tail END AS tail FROM raw")
def q_normalize_relation(spark, sf_dir):
    return merge.normalize_relation(view(spark, sf_dir, "raw")).select("extractor", "ord", "head", "relation", "tail")


_QUOTED = "CASE WHEN contains({0}, chr(39)) THEN '\"' || {0} || '\"' ELSE chr(39) || {0} || chr(39) END"


@query(f"WITH {with_views('raw')} SELECT extractor, ord, '(' || {_QUOTED.format('head')} || ', ' || relation || ', ' || {_QUOTED.format('tail')} || ') conf=' || printf('%.2f', coalesce(confidence, 0.5)) || ' src=' || source_file AS line FROM raw")
def q_triple_display(spark, sf_dir):
    c = F.col
    return view(spark, sf_dir, "raw").select("extractor", "ord", text.display(c("head"), c("relation"), c("tail"), F.coalesce("confidence", F.lit(0.5)), c("source_file")).alias("line"))


@query(f"WITH {with_views('raw')} SELECT CASE extractor WHEN 'rules' THEN 0 ELSE 1 END AS extractor_ord, extractor, ord, head, relation, tail FROM raw")
def q_union_extractors(spark, sf_dir):
    raw = view(spark, sf_dir, "raw")
    parts = [(name, raw.filter(F.col("extractor") == name).drop("extractor", "extractor_ord")) for name in ("rules", "model")]
    return merge.union_extractors(parts).select("extractor_ord", "extractor", "ord", "head", "relation", "tail")


# Model responses.

_JSON = r"""cleaned AS (SELECT *, CASE WHEN regexp_matches(trim(response), '(?s)```(?:json)?\s*.*?\s*```') THEN regexp_extract(trim(response), '(?s)```(?:json)?\s*(.*?)\s*```', 1)
WHEN strpos(trim(response), '{') > 0 THEN substring(trim(response), strpos(trim(response), '{')) ELSE trim(response) END AS body FROM responses),
good AS (SELECT * FROM cleaned WHERE json_valid(body)),
items AS (SELECT sent_pos, source_file, trim(json_extract_string(body, '$.triples[0].head')) AS head, json_extract_string(body, '$.triples[0].relation') AS rel, trim(json_extract_string(body, '$.triples[0].tail')) AS tail,
  greatest(0, least(1, coalesce(TRY_CAST(json_extract_string(body, '$.triples[0].confidence') AS DOUBLE), 0.5))) AS confidence FROM good WHERE json_array_length(body, '$.triples') > 0)"""
_RESPONSES = f"WITH {with_views('responses')}, {_JSON}"


def _parsed(spark, sf_dir):
    return responses.parse(view(spark, sf_dir, "responses").withColumn("error", F.lit(None).cast("string")))


@query(f"{_RESPONSES} SELECT sent_pos, md5(body) AS digest FROM cleaned")
def q_llm_clean(spark, sf_dir):
    return view(spark, sf_dir, "responses").select("sent_pos", F.md5(responses.clean_json(text.strip(F.col("response")))).alias("digest"))


@query(f"{_RESPONSES} SELECT sent_pos, CASE WHEN NOT json_valid(body) THEN -1 ELSE coalesce(json_array_length(body, '$.triples'), 0) END::BIGINT AS n FROM cleaned")
def q_llm_parse(spark, sf_dir):
    n = F.when(F.col("error").isNotNull(), -1).otherwise(F.coalesce(F.when(F.col("triples").isNotNull(), F.size("triples")), F.lit(0)))
    return _parsed(spark, sf_dir).select("sent_pos", n.cast("long").alias("n"))


@query(f"{_RESPONSES} SELECT source_file, sentence, count(*) AS n FROM cleaned WHERE NOT json_valid(body) GROUP BY ALL")
def q_llm_errors(spark, sf_dir):
    return responses.errors(_parsed(spark, sf_dir)).groupBy("source_file", "sentence").agg(F.count("*").alias("n"))


@query(f"{_RESPONSES} SELECT source_file, CASE WHEN rel = 'customer_of' THEN tail ELSE head END AS head, CASE WHEN rel = 'customer_of' THEN head ELSE tail END AS tail, CASE WHEN rel = 'customer_of' THEN 'supplier_of' WHEN rel = 'supplier_of' THEN rel ELSE 'INVALID:' || rel END AS relation, confidence, count(*) AS n FROM items WHERE head <> '' AND tail <> '' GROUP BY ALL")
def q_llm_triples(spark, sf_dir):
    return responses.triples(_parsed(spark, sf_dir)).groupBy("source_file", "head", "tail", "relation", "confidence").agg(F.count("*").alias("n"))


def _repeat(prompt: str) -> str:
    return prompt.removeprefix("Repeat: ")


@query(f"{_RESPONSES} SELECT md5(response) AS digest, 1::BIGINT AS calls, count(*) AS n, count(*) FILTER (WHERE json_valid(body)) AS good FROM cleaned GROUP BY response")
def q_llm_once(spark, sf_dir):
    """Answers through the ledger: half of the rows first, then all, from a model that repeats; calls is how often a prompt was paid for."""
    asked = view(spark, sf_dir, "responses").select("sent_pos", "source_file", "sentence", F.concat(F.lit("Repeat: "), "response").alias("prompt"))
    path = new_folder(spark, "answers")
    responses.complete(asked.filter("sent_pos % 2 = 0"), lambda: _repeat, path, rate=None)
    parsed = responses.parse(responses.complete(asked, lambda: _repeat, path, rate=None))
    counted = parsed.groupBy("prompt").agg(F.count("*").alias("n"), F.count_if(F.col("error").isNull()).alias("good")).withColumn("key", ledger.key_of(F.col("prompt"), ""))
    calls = ledger.calls(spark, path).groupBy("key").agg(F.count("*").alias("calls"))
    return counted.join(calls, "key", "left").select(F.md5(F.substring("prompt", 9, 1 << 30)).alias("digest"), "calls", "n", "good")


@query(rf"{_SENTENCES} SELECT source_file, sent_pos, sha256('Filing company: Unknown Company' || chr(10) || 'Sentence: ' || sentence || chr(10)) AS prompt_hash FROM sentences WHERE {_RELEVANT}")
def q_prompts(spark, sf_dir):
    sents = text.sentences(filings(spark, sf_dir)).filter(text.is_relevant(F.col("sentence")))
    return responses.prompts(resolve.with_filer(sents, filer_table(spark, {"NONE": "x"}))).select("source_file", "sent_pos", "prompt_hash")


# Names and merging. The SQL resolves names with the same lists as LEXICON.

_NOISE = ", ".join("'" + n.replace("'", "''") + "'" for n in LEXICON.noise)
_CANON = "canon AS (SELECT 'nation_' || k || s AS ckey, CASE WHEN k = 24 THEN NULL ELSE 'NATION_' || k END AS canonical FROM range(25) t(k), (VALUES (''), (' corp')) u(s))"


def _sql_resolve(source: str, columns: str, name: str, out: str) -> str:
    """A SELECT over `source` that adds what `name` stands for."""
    pronoun = fixed.PRONOUN
    return rf"""SELECT {columns}, CASE WHEN p = '' THEN NULL WHEN regexp_matches(p, '^{pronoun}$', 'i') THEN nullif(filer, '')
WHEN lower(c) NOT IN ({_NOISE}) AND NOT regexp_matches(c, '^{LEXICON.junk}', 'i') THEN c END AS {out}
FROM (SELECT x.*, CASE WHEN k1.ckey IS NULL AND k2.ckey IS NULL THEN p ELSE coalesce(k1.canonical, k2.canonical) END AS c
FROM (SELECT *, trim({name}) AS p, rtrim(lower(trim({name})), '.,; ') AS k FROM {source}) x
LEFT JOIN canon k1 ON k1.ckey = x.k LEFT JOIN canon k2 ON k2.ckey = regexp_replace(x.k, '''s$', '')) y"""


_FILER = "filed AS (SELECT *, CASE WHEN regexp_matches(source_file, '^N1?[0-9]_2023') THEN 'NATION_' || regexp_extract(source_file, '^N([0-9]+)_', 1) ELSE '' END AS filer FROM raw)"
_VALID = r"""(length({0}) >= 3 AND NOT regexp_matches({0}, '^[A-Z0-9]{{1,4}}$') AND regexp_matches({0}, '[A-Za-z]') AND NOT starts_with(lower({0}), 'the ')
AND len(regexp_split_to_array(trim({0}), '\s+')) <= 6)"""


def _anchor(c: str) -> str:
    return f"({c} IN ({', '.join(chr(39) + a + chr(39) for a in LEXICON.anchors)}))"


_BASE = "extractor, extractor_ord, ord, head AS raw_head, tail AS raw_tail, relation, coalesce(confidence, 0.5) AS confidence, source_file, source_sentence, filer"
_JUDGED = f"""WITH {with_views('raw')}, {_CANON}, {_FILER},
r1 AS ({_sql_resolve('filed', _BASE, 'head', 'head')}), r2 AS ({_sql_resolve('r1', '* EXCLUDE (p, k, c)', 'raw_tail', 'tail')}),
judged AS (SELECT *, CASE WHEN head IS NULL OR tail IS NULL THEN 'no_entity' WHEN head = tail THEN 'self_loop'
  WHEN relation NOT IN ({', '.join(chr(39) + r + chr(39) for r in fixed.RELATIONS)}) THEN 'bad_rel' WHEN NOT {_anchor('head')} AND NOT {_anchor('tail')} THEN 'no_anchor'
  WHEN (NOT {_anchor('head')} AND NOT {_VALID.format('head')}) OR (NOT {_anchor('tail')} AND NOT {_VALID.format('tail')}) THEN 'bad_entity' END AS reason FROM r2),
merged AS (SELECT *, row_number() OVER (PARTITION BY head, relation, tail ORDER BY confidence DESC, extractor_ord, ord) AS k,
  min(extractor_ord * 100000 + ord) OVER (PARTITION BY head, relation, tail) AS first_ord FROM judged WHERE reason IS NULL)"""


def judged(spark, sf_dir):
    return merge.judge(view(spark, sf_dir, "raw"), LEXICON)


@query(f"WITH {with_views('raw')}, {_CANON}, n AS (SELECT DISTINCT head AS name FROM raw UNION SELECT tail FROM raw), k AS (SELECT name, rtrim(lower(trim(name)), '.,; ') AS k FROM n) SELECT name, CASE WHEN a.ckey IS NULL AND b.ckey IS NULL THEN trim(name) ELSE coalesce(a.canonical, b.canonical) END AS canonical FROM k LEFT JOIN canon a ON a.ckey = k LEFT JOIN canon b ON b.ckey = regexp_replace(k, '''s$', '')")
def q_canonicalize(spark, sf_dir):
    raw = view(spark, sf_dir, "raw")
    names = raw.select(F.col("head").alias("name")).union(raw.select("tail")).distinct()
    return resolve.canonicalize(names, "name", canon_table(spark, LEXICON), "canonical")


_GATE = rf"""(length(name) >= 3 AND NOT (regexp_matches(name, '^{fixed.SHORT_CAPITALS}$') AND name NOT IN ({_listed(fixed.KNOWN_CAPITALS)})) AND regexp_matches(name, '[A-Za-z]') AND NOT (starts_with(lower(name), 'the ') AND name NOT IN ({_listed(LEXICON.anchors)}))
AND left(name, 1) NOT IN ('•', '–', '—', '-', '/') AND NOT regexp_matches(name, '^{LEXICON.generic}', 'i') AND NOT (regexp_matches(name, '^{LEXICON.product}', 'i') AND name NOT IN ({_listed(fixed.NO_PRODUCTS)}))
AND NOT ({' OR '.join(f"ends_with(name, '{c}')" for c in fixed.CATEGORIES)}) AND name NOT IN ({_listed(LEXICON.not_companies)}) AND len(regexp_split_to_array(trim(name), '\s+')) <= 6)"""
_MORE = ", ".join(f"({_listed([w])})" for w in (*fixed.NO_PRODUCTS, *fixed.KNOWN_CAPITALS, *LEXICON.not_companies, *fixed.CATEGORIES))


@query(rf"WITH {with_views('raw', 'names')}, n AS (SELECT DISTINCT head AS name FROM raw UNION SELECT tail FROM raw UNION SELECT name FROM names UNION SELECT * FROM (VALUES {_MORE}) v(name)) SELECT name, regexp_matches(name, '^{fixed.PRONOUN}$', 'i') AS pronoun, lower(name) IN ({_NOISE}) AS noise, regexp_matches(name, '^{LEXICON.junk}', 'i') AS junk, {_GATE} AS valid FROM n")
def q_name_filters(spark, sf_dir):
    raw = view(spark, sf_dir, "raw")
    more = spark.sql(f"SELECT name FROM (VALUES {_MORE}) v(name)")
    names = raw.select(F.col("head").alias("name")).union(raw.select("tail")).union(view(spark, sf_dir, "names")).union(more).distinct()
    c = F.col("name")
    return names.select("name", resolve.is_pronoun(c).alias("pronoun"), resolve.is_noise(c, LEXICON).alias("noise"), resolve.is_junk(c, LEXICON).alias("junk"), resolve.looks_like_company(c, LEXICON).alias("valid"))


@query(f"{_JUDGED} SELECT extractor, ord, raw_head, head, raw_tail, tail, filer FROM judged")
def q_resolve(spark, sf_dir):
    return judged(spark, sf_dir).select("extractor", "ord", "raw_head", "head", "raw_tail", "tail", "filer")


@query(f"{_JUDGED} SELECT extractor, ord, {_anchor('head')} AS head_anchor, {_anchor('tail')} AS tail_anchor FROM judged WHERE head IS NOT NULL AND tail IS NOT NULL")
def q_anchor_rule(spark, sf_dir):
    named = judged(spark, sf_dir).filter("head IS NOT NULL AND tail IS NOT NULL")
    return named.select("extractor", "ord", resolve.is_anchor(F.col("head"), LEXICON).alias("head_anchor"), resolve.is_anchor(F.col("tail"), LEXICON).alias("tail_anchor"))


@query(f"{_JUDGED} SELECT extractor, reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY ALL")
def q_reject_reasons(spark, sf_dir):
    return merge.reject_counts(judged(spark, sf_dir))


@query(f"{_JUDGED} SELECT head, relation, tail, confidence, extractor, ord, source_file, source_sentence FROM merged WHERE k = 1")
def q_merge_dedupe(spark, sf_dir):
    return merge.keep_best(judged(spark, sf_dir)).select("head", "relation", "tail", "confidence", "extractor", "ord", "source_file", "source_sentence")


@query(f"{_JUDGED}, b AS (SELECT *, max(confidence) OVER (PARTITION BY head, relation, tail ORDER BY extractor_ord, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM judged WHERE reason IS NULL) SELECT extractor, count(*) FILTER (WHERE best IS NULL OR confidence > best) AS kept FROM b GROUP BY extractor")
def q_merge_kept_running(spark, sf_dir):
    return merge.kept_counts(judged(spark, sf_dir))


@query(f"{_JUDGED} SELECT row_number() OVER (ORDER BY confidence DESC, head, relation, first_ord)::INT AS place, head, relation, tail FROM merged WHERE k = 1")
def q_merge_sorted(spark, sf_dir):
    return merge.placed(merge.keep_best(judged(spark, sf_dir))).select(F.col("place").cast("int").alias("place"), "head", "relation", "tail")


@query(f"{_JUDGED} SELECT relation, count(*) AS n, repeat('█', count(*)) AS bar FROM merged WHERE k = 1 GROUP BY relation")
def q_relation_counts(spark, sf_dir):
    return reports.relation_counts(merge.keep_best(judged(spark, sf_dir)))


@query(f"{_JUDGED} SELECT company, CASE WHEN {_anchor('company')} THEN ' ★' ELSE '' END AS star FROM (SELECT head AS company FROM merged WHERE k = 1 UNION SELECT tail FROM merged WHERE k = 1) c")
def q_companies(spark, sf_dir):
    return reports.companies(merge.keep_best(judged(spark, sf_dir)), LEXICON)


@query(f"{_JUDGED} SELECT count(*) AS triples, count(DISTINCT (head, relation, tail)) AS unique_triples, (SELECT count(*) FROM (SELECT head FROM merged WHERE k = 1 UNION SELECT tail FROM merged WHERE k = 1) c) AS companies FROM merged WHERE k = 1")
def q_totals(spark, sf_dir):
    return reports.totals(merge.keep_best(judged(spark, sf_dir)))


@query(f"WITH {with_views('raw')}, f AS (SELECT concat('N', n_nationkey, '_2023.txt') AS source_file FROM nation) SELECT f.source_file, count(raw.ord) AS triples, count(raw.ord) FILTER (WHERE starts_with(relation, 'INVALID')) AS errors FROM f LEFT JOIN raw USING (source_file) GROUP BY f.source_file")
def q_per_file_counts(spark, sf_dir):
    raw = view(spark, sf_dir, "raw")
    files = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("N"), "n_nationkey", F.lit("_2023.txt")).alias("source_file"))
    return reports.per_file(files, raw, raw.filter(F.col("relation").startswith("INVALID")))


# The graph.

_EDGES = f"WITH RECURSIVE {with_views('edges')}"
_RISK = """evidence AS (SELECT src AS disrupted, dst AS impacted, src AS head, dst AS tail, relation, confidence, source_file, source_sentence, edge_ord, 'forward' AS direction FROM edges WHERE relation = 'supplier_of'
UNION ALL SELECT dst, src, src, dst, relation, confidence, source_file, source_sentence, edge_ord, 'reverse' FROM edges WHERE relation IN ('depends_on', 'customer_of')),
risk AS (SELECT DISTINCT disrupted, impacted FROM evidence), names AS (SELECT src AS name FROM edges UNION SELECT dst FROM edges),
walk AS (SELECT name AS start, name AS node, [name] AS path, 0 AS hops FROM names UNION ALL
  SELECT w.start, r.impacted, list_append(w.path, r.impacted), w.hops + 1 FROM walk w JOIN risk r ON r.disrupted = w.node WHERE w.hops < 5 AND NOT list_contains(w.path, r.impacted)),
paths AS (SELECT start, path, hops FROM walk WHERE hops > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY hops, path) AS rank FROM paths),
top AS (SELECT * FROM ranked WHERE rank <= 25)"""
_PATHS = f"{_EDGES}, {_RISK}"


def _edges(spark, sf_dir):
    return graph.edges(view(spark, sf_dir, "edges").withColumnsRenamed({"src": "head", "dst": "tail"}))


def _top(edge_table: DataFrame) -> DataFrame:
    return materialize(graph.first_paths(graph.cascade_paths(edge_table, limit=25), 25), "top")


@query(f"{_EDGES} SELECT src, dst, relation, confidence, source_file, source_sentence, edge_ord FROM edges WHERE src <> dst")
def q_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(f"{_EDGES} SELECT count(*) AS edges, (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges) n) AS nodes FROM edges")
def q_graph_counts(spark, sf_dir):
    return graph.counts(_edges(spark, sf_dir))


@query(f"{_EDGES} SELECT src || ' --' || relation || '--> ' || dst AS edge FROM (SELECT * FROM edges ORDER BY edge_ord LIMIT 5) e")
def q_sample_edges(spark, sf_dir):
    return graph.sample_edges(_edges(spark, sf_dir))


@query(f"{_PATHS} SELECT disrupted, impacted FROM risk")
def q_risk_adjacency(spark, sf_dir):
    return graph.risk_adjacency(_edges(spark, sf_dir))


@query(f"{_PATHS} SELECT start, array_to_string(path, ' -> ') AS path, hops FROM paths")
def q_cascade_paths(spark, sf_dir):
    return graph.cascade_paths(_edges(spark, sf_dir)).select("start", graph.path_text(F.col("path")).alias("path"), "hops")


@query(f"{_PATHS} SELECT start, array_to_string(path, ' -> ') AS path, hops, rank::INT AS rank FROM top")
def q_cascade_topn(spark, sf_dir):
    return _top(_edges(spark, sf_dir)).select("start", graph.path_text(F.col("path")).alias("path"), "hops", "rank")


@query(f"{_PATHS} SELECT start, array_to_string(path, ' -> ') AS path FROM top WHERE path[-1] = 'NATION_7'")
def q_cascade_target(spark, sf_dir):
    return graph.to_target(_top(_edges(spark, sf_dir)), "NATION_7").select("start", graph.path_text(F.col("path")).alias("path"))


@query(f"{_PATHS} SELECT start, array_to_string(path, ' -> ') AS path, hops FROM paths WHERE path[-1] = 'NATION_7' QUALIFY row_number() OVER (PARTITION BY start ORDER BY hops, path) <= 3")
def q_cascade_to_target(spark, sf_dir):
    """The target before the limit: paths are pruned by their distance to it."""
    edge_table = _edges(spark, sf_dir)
    pairs = graph.nodes(edge_table).select(F.col("name").alias("start"), F.lit("NATION_7").alias("target"))
    return graph.paths_to(edge_table, pairs, 5, 3).select("start", graph.path_text(F.col("path")).alias("path"), "hops")


@query(f"{_JUDGED} SELECT head, relation, tail, confidence, extractor, ord, source_file, first_ord // 100000 AS first_extractor, (first_ord % 100000)::INT AS first_ord FROM merged WHERE k = 1")
def q_merge_kept_up(spark, sf_dir):
    """The merged state after three batches of files, in another order than the files', one of which comes twice."""
    raw = view(spark, sf_dir, "raw")
    store = BucketStore(spark, new_folder(spark, "state"), merge.KEY, 8)
    for batch, part in enumerate((2, 0, 2, 1)):
        some = raw.filter(F.pmod(F.crc32(F.col("source_file").cast("binary")), F.lit(3)) == part)
        store.merge(merge.state_rows(merge.judge(some, LEXICON)), merge.combine, batch)
    return store.read().select("head", "relation", "tail", "confidence", "extractor", "ord", "source_file", F.col("first_ord.extractor_ord").cast("long").alias("first_extractor"), F.col("first_ord.ord").alias("first_ord"))


_HOPS = "hops AS (SELECT start, path, unnest(range(1, len(path))) AS h FROM top), steps AS (SELECT start, path, h, e.* FROM hops JOIN evidence e ON e.disrupted = path[h] AND e.impacted = path[h + 1])"


@query(f"{_PATHS}, {_HOPS} SELECT start, array_to_string(path, ' -> ') AS path, (row_number() OVER (PARTITION BY start, path ORDER BY h, direction, edge_ord) - 1)::INT AS place, head, relation, tail, confidence, source_file, source_sentence, direction AS traversal_direction FROM steps")
def q_path_evidence(spark, sf_dir):
    edge_table = _edges(spark, sf_dir)
    found = graph.path_evidence(_top(edge_table), edge_table)
    return found.select("start", graph.path_text(F.col("path")).alias("path"), F.posexplode("relationships").alias("place", "r")).select("start", "path", "place", "r.*")


@query(f"{_PATHS} SELECT start, array_to_string(path, ' -> ') AS path, hops FROM top WHERE path = (SELECT max(path) FROM top)")
def q_exact_path(spark, sf_dir):
    top = _top(_edges(spark, sf_dir))
    names = top.agg(F.max("path").alias("path")).first()["path"]
    return graph.find_path(top, names).select("start", graph.path_text(F.col("path")).alias("path"), "hops")


@query(f"""{_PATHS}, two AS (SELECT start, path, hops, row_number() OVER (PARTITION BY start ORDER BY hops, path) AS rank FROM paths WHERE hops <= 2), best AS (SELECT * FROM two WHERE rank <= 10), {_HOPS.replace('FROM top', 'FROM best')},
t AS (SELECT start, path, string_agg(head || ' --' || relation || '--> ' || tail || chr(10) || 'Traversal: ' || direction || chr(10) || 'Source: ' || source_file || chr(10) || 'Evidence: ' || source_sentence, chr(10) ORDER BY h, direction, edge_ord) AS rels FROM steps GROUP BY start, path)
SELECT b.start, rank::INT AS rank, md5('Cascade path:' || chr(10) || array_to_string(b.path, ' -> ') || chr(10) || rels) AS digest FROM best b JOIN t ON t.start = b.start AND t.path = b.path""")
def q_demonstration(spark, sf_dir):
    edge_table = _edges(spark, sf_dir)
    starts = graph.nodes(edge_table).select(F.col("name").alias("start"))
    return drivers.demonstration(edge_table, starts).select("start", "rank", F.md5("text").alias("digest"))


# Questions.

_Q = f"""WITH RECURSIVE {with_views('edges', 'questions')}, {_RISK},
node_ords AS (SELECT name, min(o) AS node_ord FROM (SELECT src AS name, edge_ord * 2 AS o FROM edges UNION ALL SELECT dst, edge_ord * 2 + 1 FROM edges) t GROUP BY name),
phrases AS (SELECT * FROM (VALUES (0, 'disruption in '), (1, 'disruption at '), (2, 'disruption of '), (3, 'disruption to ')) p(k, phrase)),
after AS (SELECT id, k, substring(lower(question), strpos(lower(question), phrase) + length(phrase)) AS rest FROM questions, phrases WHERE strpos(lower(question), phrase) > 0),
named AS (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY k, length(name) DESC, node_ord) AS r FROM after JOIN node_ords ON starts_with(rest, lower(name))),
mentions AS (SELECT id, name, node_ord, strpos(lower(question), lower(name)) AS pos FROM questions JOIN node_ords ON contains(lower(question), lower(name))),
firsts AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos, node_ord) AS r FROM mentions),
lists AS (SELECT id, list(name ORDER BY pos, node_ord) AS companies FROM mentions GROUP BY id),
linked AS (SELECT q.id, q.question, coalesce(n.name, f.name) AS start, coalesce(companies, []) AS companies FROM questions q LEFT JOIN named n ON n.id = q.id AND n.r = 1 LEFT JOIN firsts f ON f.id = q.id AND f.r = 1 LEFT JOIN lists l ON l.id = q.id),
aimed AS (SELECT *, list_filter(companies, lambda c: c <> start)[1] AS target FROM linked),
chosen AS (SELECT a.id, a.start, a.target, t.path, t.hops, t.rank FROM aimed a JOIN top t ON t.start = a.start WHERE a.target IS NULL OR t.path[-1] = a.target),
picked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY len(path) DESC, rank) AS k FROM chosen), deep AS (SELECT * FROM picked WHERE k <= 3)"""


def _linked(spark, sf_dir):
    return questions.link(view(spark, sf_dir, "questions"), graph.nodes(_edges(spark, sf_dir)))


def _answers(spark, sf_dir):
    return questions.answer_questions(view(spark, sf_dir, "questions"), _edges(spark, sf_dir))


@query(f"{_Q} SELECT id, start FROM linked")
def q_question_start(spark, sf_dir):
    return questions.starts(view(spark, sf_dir, "questions"), graph.nodes(_edges(spark, sf_dir)))


@query(f"{_Q} SELECT id, array_to_string(companies, ',') AS companies FROM linked")
def q_question_mentions(spark, sf_dir):
    return questions.mention_lists(view(spark, sf_dir, "questions"), graph.nodes(_edges(spark, sf_dir))).select("id", F.array_join("companies", ",").alias("companies"))


@query(f"{_Q} SELECT id, start, target FROM aimed")
def q_question_target(spark, sf_dir):
    return _linked(spark, sf_dir).select("id", "start", "target")


@query(f"{_Q} SELECT id, k::INT AS select_rank, array_to_string(path, ' -> ') AS path FROM deep")
def q_deepest_paths(spark, sf_dir):
    edge_table = _edges(spark, sf_dir)
    linked = questions.link(view(spark, sf_dir, "questions"), graph.nodes(edge_table)).select("id", "start", "target")
    hits = linked.join(_top(edge_table), "start").filter(F.col("target").isNull() | (F.element_at("path", -1) == F.col("target")))
    return questions.deepest(hits).select("id", "select_rank", graph.path_text(F.col("path")).alias("path"))


@query(f"{_Q}, d AS (SELECT id, max(hops) AS max_depth FROM chosen GROUP BY id) SELECT q.id, CASE WHEN start IS NULL THEN 'NO_COMPANY' WHEN max_depth IS NULL THEN 'NO_PATH' ELSE 'OK' END AS status, max_depth FROM linked q LEFT JOIN d USING (id)")
def q_answer_status(spark, sf_dir):
    return _answers(spark, sf_dir).select("id", "status", "max_depth")


@query(f"""{_Q}, h AS (SELECT id, k, path, unnest(range(1, len(path))) AS h FROM deep), s AS (SELECT id, k, path, e.*, row_number() OVER (PARTITION BY id, k ORDER BY h, direction, edge_ord) AS place FROM h JOIN evidence e ON e.disrupted = path[h] AND e.impacted = path[h + 1]),
t AS (SELECT id, k, any_value(path) AS path, string_agg('Relationship ' || place || ':' || chr(10) || head || ' --' || relation || '--> ' || tail || chr(10) || 'Confidence: ' || coalesce(printf('%.2f', confidence), 'not provided') || chr(10) || 'Source: ' || source_file || chr(10) || 'Evidence: ' || source_sentence || chr(10), chr(10) ORDER BY place) AS rels FROM s GROUP BY id, k),
c AS (SELECT id, string_agg('PATH ' || k || chr(10) || 'Graph path: ' || array_to_string(path, ' -> ') || chr(10) || 'Hop count: ' || (len(path) - 1) || chr(10) || chr(10) || rels, chr(10) || chr(10) ORDER BY k) AS context FROM t GROUP BY id)
SELECT q.id, md5(coalesce(context, '{questions.NO_EVIDENCE}')) AS digest FROM linked q LEFT JOIN c USING (id)""")
def q_rag_context(spark, sf_dir):
    return _answers(spark, sf_dir).select("id", F.md5("context").alias("digest"))


# Layout and evaluation.

_LAYOUT = f"""{_PATHS}, pairs AS (SELECT start, path, unnest(range(1, len(path))) AS h FROM top), steps AS (SELECT DISTINCT start, path[h] AS src, path[h + 1] AS dst FROM pairs),
reach AS (SELECT DISTINCT start, start AS node, 0 AS hop FROM steps UNION SELECT r.start, s.dst, r.hop + 1 FROM reach r JOIN steps s ON s.start = r.start AND s.src = r.node WHERE r.hop < 5),
dist AS (SELECT start, node, min(hop) AS hop FROM reach GROUP BY start, node),
l0 AS (SELECT start, node, hop, 0 AS layer_pos FROM dist WHERE hop = 0), l1 AS (SELECT start, node, hop, row_number() OVER (PARTITION BY start ORDER BY node) - 1 AS layer_pos FROM dist WHERE hop = 1)""" + "".join(
    f""", m{h} AS (SELECT s.start, s.dst AS node, avg(l.layer_pos) AS mean FROM steps s JOIN l{h - 1} l ON l.start = s.start AND l.node = s.src GROUP BY s.start, s.dst),
l{h} AS (SELECT start, node, hop, row_number() OVER (PARTITION BY start ORDER BY mean ASC NULLS LAST, node) - 1 AS layer_pos FROM dist LEFT JOIN m{h} USING (start, node) WHERE hop = {h})"""
    for h in range(2, 6)
) + ", placed AS (" + " UNION ALL ".join(f"SELECT * FROM l{h}" for h in range(6)) + ")"


@query(f"{_LAYOUT} SELECT start, node, hop FROM dist")
def q_layout_hops(spark, sf_dir):
    return layout.distances(materialize(layout.path_edges(_top(_edges(spark, sf_dir))), "steps"))


@query(f"""{_LAYOUT} SELECT start, node, hop, layer_pos::INT AS layer_pos, round(hop * 3.8, 6)::DOUBLE AS x, round(((count(*) OVER (PARTITION BY start, hop) - 1) / 2.0 - layer_pos) * 1.7, 6)::DOUBLE AS y,
CASE least(hop, 5) WHEN 0 THEN '#E31A1C' WHEN 1 THEN '#FDAE61' WHEN 2 THEN '#FFFFBF' WHEN 3 THEN '#ABDDA4' WHEN 4 THEN '#3288BD' ELSE '#8e63b6' END AS color,
CASE WHEN node = start THEN 3200 WHEN node = 'NATION_7' THEN 2700 WHEN hop = 1 THEN 2500 ELSE 2200 END AS size, CASE WHEN hop = 0 THEN 'Disrupted company' ELSE hop || '-hop' END AS heading FROM placed""")
def q_layout_positions(spark, sf_dir):
    placed = layout.styled(layout.positions(_top(_edges(spark, sf_dir))), "NATION_7")
    return placed.withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6))


_GAPS = f"""{_PATHS}, hops AS (SELECT start, path, unnest(range(1, len(path))) AS h FROM top), kept AS (SELECT * FROM edges WHERE edge_ord % 4 <> 1),
step AS (SELECT start, path, h, path[h] || ' -> ' || path[h + 1] AS name, EXISTS (SELECT 1 FROM kept WHERE (src = path[h] AND dst = path[h + 1]) OR (src = path[h + 1] AND dst = path[h])) AS backed,
  EXISTS (SELECT 1 FROM kept WHERE (relation = 'supplier_of' AND src = path[h] AND dst = path[h + 1]) OR (relation IN ('depends_on', 'customer_of') AND src = path[h + 1] AND dst = path[h])) AS carried FROM hops),
score AS (SELECT start, path, count(*) AS hop_count, CASE count(*) FILTER (WHERE NOT backed) WHEN 0 THEN 2 WHEN count(*) THEN 0 ELSE 1 END AS b, CASE count(*) FILTER (WHERE NOT carried) WHEN 0 THEN 2 WHEN count(*) THEN 0 ELSE 1 END AS c,
  coalesce(string_agg(name, '; ' ORDER BY h) FILTER (WHERE NOT backed), '') AS unsupported_steps, coalesce(string_agg(name, '; ' ORDER BY h) FILTER (WHERE NOT carried), '') AS direction_errors FROM step GROUP BY start, path)"""


def _gaps(spark, sf_dir):
    """Paths with all relations between their steps' companies that a part of the edges has: some steps lack any, some the direction."""
    edge_table = _edges(spark, sf_dir)
    kept = edge_table.filter(F.col("edge_ord") % 4 != 1).select(F.col("src").alias("head"), "relation", F.col("dst").alias("tail"))
    top = _top(edge_table).select("start", "path")
    pairs = top.select("start", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda k: F.array(F.get("path", k - 1), F.get("path", k)))).alias("pair"))
    both = F.array_sort(F.array("head", "tail"))
    found = pairs.withColumn("pair", F.array_sort("pair")).join(kept.withColumn("pair", both), "pair").groupBy("start", "path").agg(F.collect_list(F.struct("head", "relation", "tail")).alias("relationships"))
    empty = F.array().cast("array<struct<head:string,relation:string,tail:string>>")
    return evaluate.rule_judge(top.join(found, ["start", "path"], "left").withColumn("relationships", F.coalesce("relationships", empty)))


@query(f"{_GAPS} SELECT start, array_to_string(path, ' -> ') AS path, hop_count::INT AS hop_count, b AS path_continuity, b AS evidence_coverage, c AS direction_consistency, c AS cascade_relevance, 2 AS path_quality, 2 * b + 2 * c + 2 AS total_score, unsupported_steps, direction_errors FROM score")
def q_eval_scores(spark, sf_dir):
    rows = evaluate.path_rows(_gaps(spark, sf_dir))
    return rows.select(F.split("path", " -> ")[0].alias("start"), *rows.columns[: rows.columns.index("direction_errors") + 1])


@query(f"{_GAPS} SELECT printf('%.1f', avg(2 * b + 2 * c + 2)) AS average FROM score")
def q_eval_mean(spark, sf_dir):
    return evaluate.mean_score(_gaps(spark, sf_dir))


@query(f"""{_PATHS}, {_HOPS}, r AS (SELECT start, path, h, string_agg(head || ' --' || relation || '--> ' || tail || chr(10) || 'Source: ' || source_file || chr(10) || 'Evidence: ' || source_sentence, chr(10) ORDER BY direction, edge_ord) AS rels
FROM (SELECT h.start, h.path, h.h, e.* FROM hops h JOIN (SELECT * FROM evidence) e ON (e.head = h.path[h.h] AND e.tail = h.path[h.h + 1]) OR (e.head = h.path[h.h + 1] AND e.tail = h.path[h.h])) x
WHERE (disrupted = path[h] AND impacted = path[h + 1]) GROUP BY ALL),
t AS (SELECT start, path, string_agg('STEP ' || h || ': ' || path[h] || ' -> ' || path[h + 1] || chr(10) || rels || chr(10), chr(10) ORDER BY h) AS steps FROM r GROUP BY start, path)
SELECT start, array_to_string(path, ' -> ') AS path, md5('Path: ' || array_to_string(path, ' -> ') || chr(10) || 'Hop count: ' || (len(path) - 1) || chr(10) || chr(10) || steps) AS digest FROM t""")
def q_eval_step_format(spark, sf_dir):
    edge_table = _edges(spark, sf_dir)
    found = graph.path_evidence(_top(edge_table), edge_table)
    digest = found.withColumn("digest", F.md5(evaluate.step_text(F.col("path"), F.col("relationships"))))
    return digest.select("start", graph.path_text(F.col("path")).alias("path"), "digest")


# Incremental work, and what has no SQL.

@query(f"WITH {_FILINGS} SELECT source_file FROM filings WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE ends_with(source_file, '_' || l.doc_id || '.txt'))")
def q_resume_antijoin(spark, sf_dir):
    """Filings that are not done; those whose documents have a label are."""
    read = filings(spark, sf_dir)
    done = spark.read.parquet(f"{sf_dir}/labels.parquet").join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").select(F.concat(F.upper("source"), F.lit("_"), "doc_id", F.lit(".txt")).alias("source_file"))
    return incremental.pending(read, done).select("source_file")


@query()
def q_annotate_extract(spark, sf_dir):
    """Triples of the plain annotator and the rules, over all sentences of all documents."""
    sents = text.sentences(filings(spark, sf_dir)).filter(text.fits_rules(F.col("sentence")))
    found = rules.extract(resolve.with_filer(annotate.annotate(sents), filer_table(spark, {"SRC1": "One"})))
    return found.select("head", "relation", "tail", "confidence", "source_file", "source_sentence")
