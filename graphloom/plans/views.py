"""Views on the driver's tables that queries and their DuckDB SQL share: the same text serves both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.functions.lexicon import Lexicon
from graphloom.sources.storage import materialize

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Trade between nations, by exact sums.
FLOW = """
SELECT sn.n_name AS src, cn.n_name AS dst, sum(CAST(l.l_extendedprice AS DECIMAL(18, 2))) AS rev, count(*) AS n
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation sn ON s.s_nationkey = sn.n_nationkey JOIN nation cn ON c.c_nationkey = cn.n_nationkey
GROUP BY sn.n_name, cn.n_name
"""
#: The two largest customers of each nation.
TRADE = """
SELECT src, dst, n, rk, row_number() OVER (ORDER BY src, rk) AS i FROM (
  SELECT src, dst, n, row_number() OVER (PARTITION BY src ORDER BY rev DESC, dst) AS rk FROM flow WHERE src <> dst) t
WHERE rk <= 2
"""
#: The largest supplier of each nation.
NEED = """
SELECT src, dst, n, row_number() OVER (ORDER BY dst) AS i FROM (
  SELECT src, dst, n, row_number() OVER (PARTITION BY dst ORDER BY rev DESC, src) AS rk FROM flow WHERE src <> dst) t
WHERE rk = 1
"""
#: The graph: what nations sell, what they depend on, and rivals, which carry no risk.
EDGES = """
SELECT src, dst, 'supplier_of' AS relation, CAST(50 + n % 50 AS DOUBLE) / 100 AS confidence, concat(replace(src, 'NATION_', 'N'), '_2023.txt') AS source_file,
       concat(src, ' sells to ', dst) AS source_sentence, CAST(i AS INT) AS edge_ord FROM trade
UNION ALL
SELECT dst, src, 'depends_on', CAST(50 + n % 50 AS DOUBLE) / 100, concat(replace(dst, 'NATION_', 'N'), '_2023.txt'), concat(dst, ' relies on ', src), CAST(1000 + i AS INT) FROM need
UNION ALL
SELECT src, dst, 'competitor_of', CAST(NULL AS DOUBLE), concat(replace(src, 'NATION_', 'N'), '_2023.txt'), concat(src, ' competes with ', dst), CAST(2000 + i AS INT) FROM trade WHERE rk = 2
"""
#: Triples as two extractors might give them, with names to resolve and reasons to reject.
RAW = """
SELECT 'rules' AS extractor, 0 AS extractor_ord, CAST(i AS INT) AS ord,
       CASE i % 6 WHEN 0 THEN concat(lower(src), ' Corp.') WHEN 1 THEN concat(src, '''s') WHEN 2 THEN 'we' WHEN 3 THEN concat('  ', src, ' ') ELSE src END AS head,
       CASE i % 4 WHEN 1 THEN 'depends_on' WHEN 2 THEN 'customer_of' ELSE 'supplier_of' END AS relation,
       CASE i % 7 WHEN 0 THEN 'customers' WHEN 1 THEN concat(lower(dst), ',') WHEN 5 THEN 'ir.site' ELSE dst END AS tail,
       CASE WHEN i % 11 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(50 + n % 50 AS DOUBLE) / 100 END AS confidence,
       concat(replace(src, 'NATION_', 'N'), '_2023.txt') AS source_file, concat(src, ' and ', dst) AS source_sentence FROM trade
UNION ALL
SELECT 'model', 1, CAST(i AS INT), src, CASE i % 9 WHEN 0 THEN 'INVALID:friend_of' WHEN 4 THEN 'partner_of' ELSE 'supplier_of' END,
       CASE i % 8 WHEN 0 THEN 'the company' WHEN 3 THEN 'AB' WHEN 6 THEN concat('Works ', dst) ELSE concat(dst, ' corp') END,
       CAST(40 + (n * 7) % 60 AS DOUBLE) / 100, concat(replace(src, 'NATION_', 'N'), '_2023.txt'), concat(src, ' with ', dst) FROM trade
UNION ALL
SELECT 'model', 1, CAST(500 + i AS INT), concat('Site ', src), 'partner_of', concat('Plant ', dst), 0.7, 'none.txt', 'x' FROM trade WHERE rk = 2
"""
#: Questions about nations.
QUESTIONS = """
SELECT CAST(n_nationkey AS INT) AS id, CASE n_nationkey % 5
  WHEN 0 THEN concat('What does a disruption at ', n_name, ' mean for nation_7?') WHEN 1 THEN concat('Could ', lower(n_name), ' be hit through NATION_3 by NATION_5?')
  WHEN 2 THEN concat('Is there a Disruption in ', n_name) WHEN 3 THEN 'Nothing is named here' ELSE concat('disruption of trade, disruption to ', n_name, ' and ', n_name) END AS question
FROM nation
"""
#: Answers of a model: whole, fenced, after words, before words, cut short, empty.
RESPONSES = """
SELECT CAST(event_id AS INT) AS sent_pos, concat('f', CAST(user_id AS VARCHAR(20)), '.txt') AS source_file, event_type AS sentence, CASE event_id % 6
  WHEN 0 THEN body WHEN 1 THEN concat('```json', chr(10), body, chr(10), '```') WHEN 2 THEN concat('Here: ', body) WHEN 3 THEN concat(body, chr(10), 'Note: done')
  WHEN 4 THEN substring(body, 1, 30) ELSE '{}' END AS response
FROM (SELECT *, concat('{"triples":[{"head":" A', CAST(user_id AS VARCHAR(20)), '","relation":"', CASE WHEN user_id % 4 = 0 THEN 'friend_of' WHEN user_id % 4 = 1 THEN 'customer_of' ELSE 'supplier_of' END,
  '","tail":"', CASE WHEN user_id % 10 = 0 THEN ' ' ELSE event_type END, '"', CASE WHEN user_id % 3 = 0 THEN '' ELSE concat(',"confidence":', CAST(user_id % 5 AS VARCHAR(20)), '.5') END, '}]}') AS body FROM events) t
"""


def _r(c: int, m: int) -> str:
    """A pseudorandom number below m for each (sent, i), alike in both engines."""
    return f"((((sent * 31 + i * 17 + {c} * 101) % 10007) * ((sent * 7 + i * 3 + {c} * 977) % 9973)) % 7919 % {m})"


def _pick(c: int, *values: str) -> str:
    return f"CASE {_r(c, len(values))} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


def _names(*values: str) -> list[str]:
    return [f"'{v}'" for v in values]


#: A parsed sentence for each customer, of twelve tokens with every kind of trigger, part of speech and dependency. A gap in
#: some puts entities within some windows and beyond others.
RULE_TOKENS = f"""
SELECT sent, CAST(i AS INT) AS i, CAST(i * 12 + CASE WHEN sent % 5 = 0 AND i >= 6 THEN 130 + sent % 200 ELSE 0 END AS INT) AS idx,
  {_pick(1, *_names('we', 'Our', 'it', 'w1', 'w2', 'w3', 'the company', 'w4', 'w5', 'w6'))} AS text,
  CASE WHEN dep = 'prep' THEN {_pick(2, *_names('with', 'to', 'From', 'of', 'on', 'for', 'against', 'such', 'by'))}
    ELSE {_pick(3, *_names('supply', 'Purchase', 'acquire', 'rival', 'partner', 'customer', 'supplier', 'subsidiary', 'depend', 'reliance', 'x', 'y', 'vendor', 'z'))} END AS lemma,
  {_pick(4, *_names('VERB', 'AUX', 'NOUN', 'PROPN', 'ADJ', 'NOUN'))} AS pos, dep, CAST(greatest(0, least(11, i + {_r(5, 7)} - 3)) AS INT) AS head
FROM (SELECT sent, i, {_pick(6, *_names('nsubj', 'nsubjpass', 'csubj', 'dobj', 'attr', 'prep', 'prep', 'pobj', 'nmod', 'appos', 'conj', 'poss', 'det', 'pobj', 'prep'))} AS dep
  FROM (SELECT c_custkey AS sent FROM customer) c CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11)) v(i)) t
"""
#: Their entities, among them kinds, lengths and words that are dropped.
RULE_ENTS = f"""
SELECT sent, CAST(i AS INT) AS k, {_pick(7, "' Acme '", "'Beta'", "concat('Gamma', sent % 3)", "'Exhibit 9'", "'w2'", "repeat('x', 90)", "'it'", "concat('Delta', i)", "'Acme East'")} AS text,
  CAST(i * 28 + {_r(8, 24)} + CASE WHEN sent % 3 = 0 AND i >= 3 THEN 150 + sent % 170 ELSE 0 END AS INT) AS s, CAST(i * 28 + {_r(8, 24)} + 14 + CASE WHEN sent % 3 = 0 AND i >= 3 THEN 150 + sent % 170 ELSE 0 END AS INT) AS e,
  {_pick(9, *_names('ORG', 'GPE', 'PRODUCT', 'ORG', 'PERSON', 'GPE'))} AS label
FROM (SELECT c_custkey AS sent FROM customer) c CROSS JOIN (VALUES (0), (1), (2), (3), (4)) v(i)
"""
#: Who files each sentence; not known for some.
RULE_FILERS = "SELECT c_custkey AS sent, concat('F', c_custkey % 40, '_2023.txt') AS source_file, CASE c_custkey % 4 WHEN 0 THEN CAST(NULL AS VARCHAR(9)) WHEN 1 THEN 'Acme' ELSE 'Filer' END AS filer FROM customer"
#: Names with each reason that the quality gate has, and around them.
NAMES = """
SELECT concat(p, b, s) AS name FROM (VALUES (''), ('the '), ('The '), ('• '), ('–'), ('-'), ('/ '), ('our '), ('various '), ('certain '), ('A B C D E ')) a(p)
CROSS JOIN (VALUES ('AB'), ('ABC'), ('IBM'), ('HP'), ('TSMC'), ('1234'), ('A1B2C'), ('Acme'), ('Acme Works'), ('___'), ('éé'), ('NATION_3')) c(b)
CROSS JOIN (VALUES (''), (' suppliers'), (' Suppliers'), (' customers'), (' Processors'), (' f g'), (' Inc.')) d(s)
"""
VIEWS = {"rule_tokens": RULE_TOKENS, "rule_ents": RULE_ENTS, "rule_filers": RULE_FILERS, "names": NAMES, "flow": FLOW, "trade": TRADE, "need": NEED, "edges": EDGES, "raw": RAW, "questions": QUESTIONS, "responses": RESPONSES}
_NEEDS = {"rule_tokens": (), "rule_ents": (), "rule_filers": (), "names": (), "flow": (), "trade": ("flow",), "need": ("flow",), "edges": ("flow", "trade", "need"), "raw": ("flow", "trade"), "questions": (), "responses": ()}

#: Names of the nations, as a lexicon: all but the last have an entry, even ones are anchors.
LEXICON = Lexicon(
    canonical={f"nation_{k}{s}": None if k == 24 else f"NATION_{k}" for k in range(25) for s in ("", " corp")},
    filers={f"N{k}": f"NATION_{k}" for k in range(20)},
    anchors=tuple(f"NATION_{k}" for k in range(0, 25, 2)),
)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS. Those that others build on are small and written once, so that no recursion makes them anew."""
    tables(spark, sf_dir, "nation", "customer", "supplier", "orders", "lineitem", "events")
    for need in _NEEDS[name]:
        made = spark.sql(VIEWS[need])
        (materialize(made, need) if need == "flow" else made).createOrReplaceTempView(need)
    made = spark.sql(VIEWS[name])
    return materialize(made, name) if name in ("edges", "raw") else made


def with_views(*names: str) -> str:
    """The WITH items that define these views in DuckDB."""
    found: dict[str, str] = {}
    for name in names:
        for need in (*_NEEDS[name], name):
            found[need] = VIEWS[need]
    return ", ".join(f"{k} AS ({v})" for k, v in found.items())
