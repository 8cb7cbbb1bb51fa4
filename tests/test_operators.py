import json
import random
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.functions import lexicon, schemas, text
from graphloom.functions.lexicon import Lexicon
from graphloom.operators import annotate, asof, evaluate, graph, layout, merge, questions, ranges, reports, resolve, responses, rules, spans
from graphloom.plans import catalog, drivers, pipeline
from graphloom.sources import files, ledger
from graphloom.sources.store import BucketStore
from graphloom.streaming import incremental

LEX = Lexicon(canonical={"acme corp": "Acme", "acme": "Acme", "bolt": "Bolt", "ghost notes": None}, filers={"AC": "Acme"}, anchors=("Acme", "Bolt"))


def one(spark, expression, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns)).select(expression.alias("x")).first()["x"]


def test_text(spark):
    said = 'One two. Three four) . Five 9. "Six" a. b'
    assert one(spark, text.split_sentences(F.col("t")), t=said) == ["One two", "Three four) . Five 9", '"Six" a. b']
    assert one(spark, text.clean_text(F.col("t")), t="=== ITEM 1A: x ===  a\n\tb ") == "a b"
    assert one(spark, text.strip(F.col("t")), t=" a\t") == "a"
    assert one(spark, text.ticker(F.col("t")), t="intc_2023.txt") == "INTC"
    for said, found in (("our customer x", True), ("our customers x", False), ("suppliers", False), ("A Joint Venture", True)):
        assert one(spark, text.is_relevant(F.col("t")), t=said) is found
    assert one(spark, text.is_relevant(F.col("t"), stems=True), t="suppliers") is True


def test_stats_without_sentences(spark):
    empty = spark.createDataFrame([], schemas.SENTENCES)
    assert text.relevance_stats(empty).count() == 0 and text.first_sentences(empty).count() == 0
    assert text.sentences(spark.createDataFrame([("a", None)], "source_file string, text string")).count() == 0


def test_merge(spark):
    a = [("Acme Corp.", "supplier_of", "bolt", 0.75), ("we", "supplier_of", "Bolt", 0.75), ("Acme's", "supplier_of", "BOLT", 0.85), ("Acme", "depends_on", "the company", 0.78), ("Ghost Notes", "partner_of", "Acme", 0.72), ("Cog Works", "partner_of", "Dyno Labs", 0.72), ("Cog Works", "partner_of", "Acme", 0.72), ("AB", "partner_of", "Acme", 0.72)]
    b = [("Acme", "INVALID:friend_of", "Bolt", 0.9), ("Acme", "supplier_of", "Bolt", 0.85)]
    kind = "head string, relation string, tail string, confidence double, source_file string, source_sentence string, ord int"
    parts = [(name, spark.createDataFrame([(*r, "AC_2023.txt", "s", i) for i, r in enumerate(rows)], kind)) for name, rows in (("a", a), ("b", b))]
    judged = merge.judge(merge.union_extractors(parts), LEX)
    reasons = [r["reason"] for r in judged.orderBy("extractor_ord", "ord").collect()]
    assert reasons == [None, None, None, "self_loop", "no_entity", "no_anchor", None, "bad_entity", "bad_rel", None]
    rows = merge.merge(parts, LEX).collect()
    assert [(r["head"], r["relation"], r["tail"], r["confidence"], r["extractor"], r["ord"]) for r in rows] == [("Acme", "supplier_of", "Bolt", 0.85, "a", 2), ("Cog Works", "partner_of", "Acme", 0.72, "a", 6)]
    assert {r["extractor"]: r["kept"] for r in merge.kept_counts(judged).collect()} == {"a": 3, "b": 0}
    assert {(r["extractor"], r["reason"]): r["n"] for r in merge.reject_counts(judged).collect()}["b", "bad_rel"] == 1
    assert [r["company"] for r in reports.companies(merge.merge(parts, LEX), LEX).collect()] == ["Acme", "Bolt", "Cog Works"]


def test_names(spark):
    rows = [("HP",), ("Wi-Fi",), ("the Acme Group",), ("INTC",), ("AMD Ryzen",), ("Big OEMs",), ("a b c d e f g",), ("123 4",), ("-x y",), ("Fine Name Ltd",)]
    names = spark.createDataFrame(rows, "n string")
    good = {r["n"] for r in names.filter(resolve.looks_like_company(F.col("n"), Lexicon())).collect()}
    assert good == {"Fine Name Ltd"}
    made = spark.createDataFrame([("Intel’s", ""), ("tsmc,", ""), ("we", "Micron"), ("we", ""), ("China", ""), ("ir.x.com", ""), ("  ", ""), ("New Co.", "")], "n string, filer string")
    found = resolve.resolve(made, "n", Lexicon(), "out").select("n", "filer", "out").collect()
    assert {(r["n"], r["filer"]): r["out"] for r in found} == {("Intel’s", ""): "Intel", ("tsmc,", ""): "TSMC", ("we", "Micron"): "Micron", ("we", ""): None, ("China", ""): None, ("ir.x.com", ""): None, ("  ", ""): None, ("New Co.", ""): "New Co."}


def test_lexicon_sizes():
    assert len(Lexicon().canonical) == 153 and len(lexicon.ANCHORS) == 56 and len(lexicon.NOISE) == 127 and len(lexicon.NOT_COMPANIES) == 54


EDGES = [("A", "supplier_of", "B"), ("C", "depends_on", "B"), ("B", "supplier_of", "D"), ("C", "supplier_of", "A"), ("D", "supplier_of", "E"), ("A", "competitor_of", "E"), ("A", "supplier_of", "B")]


def edges(spark, rows=EDGES):
    kind = "head string, relation string, tail string, confidence double, source_file string, source_sentence string, edge_ord int"
    return graph.edges(spark.createDataFrame([(h, r, t, 0.8, "f", f"s{i}", i) for i, (h, r, t) in enumerate(rows)], kind))


def test_graph(spark):
    made = edges(spark)
    assert {(r["disrupted"], r["impacted"]) for r in graph.risk_adjacency(made).collect()} == {("A", "B"), ("B", "C"), ("B", "D"), ("C", "A"), ("D", "E")}
    paths = graph.first_paths(graph.cascade_paths(made, "A"), 25)
    assert [r["path"] for r in paths.orderBy("rank").collect()] == [["A", "B"], ["A", "B", "C"], ["A", "B", "D"], ["A", "B", "D", "E"]]
    found = {tuple(r["path"]): r["relationships"] for r in graph.retrieve_evidence(made, "A", 5, 25).collect()}
    assert [(x["source_sentence"], x["traversal_direction"]) for x in found["A", "B", "C"]] == [("s0", "forward"), ("s6", "forward"), ("s1", "reverse")]
    assert graph.to_target(graph.retrieve_evidence(made, "A", 5, 2), "E").count() == 0
    assert graph.to_target(graph.retrieve_evidence(made, "A", 5, 4), "E").count() == 1
    assert graph.cascade_paths(made, "A", 0).count() == 0 and graph.cascade_paths(made, "E").count() == 0
    with pytest.raises(ValueError):
        graph.cascade_paths(made, "Z")
    with pytest.raises(ValueError):
        graph.cascade_paths(made, "A", -1)
    with pytest.raises(ValueError):
        graph.find_path(paths, ["A", "E"])
    assert [tuple(r["path"]) for r in questions.deepest(paths, by="start").orderBy("select_rank").collect()] == [("A", "B", "D", "E"), ("A", "B", "C"), ("A", "B", "D")]
    assert [r["impacted"] for r in graph.neighbors(made, "B").collect()] == ["C", "D"]
    assert graph.edges(spark.createDataFrame([("", "supplier_of", "x", 0.1, "", "", 0), ("a", "r", "a", 0.1, "", "", 1), ("a", None, "b", 0.1, "", "", 2)], "head string, relation string, tail string, confidence double, source_file string, source_sentence string, edge_ord int")).count() == 0


def brute_paths(risk, start, most):
    out, level = [], [[start]]
    for _ in range(most):
        level = [p + [n] for p in level for n in sorted(risk.get(p[-1], ())) if n not in p]
        out += level
    return out


def test_cascades_of_random_graphs(spark):
    rng = random.Random(1)
    for _ in range(3):
        rows = [(rng.choice("ABCDEF"), rng.choice(["supplier_of", "depends_on", "customer_of", "partner_of"]), rng.choice("ABCDEF")) for _ in range(12)]
        risk = {}
        for h, r, t in rows:
            if h != t and r != "partner_of":
                risk.setdefault(*((h, set()) if r == "supplier_of" else (t, set()))).add(t if r == "supplier_of" else h)
        paths = graph.cascade_paths(edges(spark, rows), None, 4)
        for start in {x for h, _, t in rows if h != t for x in (h, t)}:
            got = [r["path"] for r in paths.filter(F.col("start") == start).orderBy("hops", "path").collect()]
            assert got == brute_paths(risk, start, 4)


def test_questions(spark):
    names = spark.createDataFrame([("N1", 0), ("N10", 1), ("Arm", 2), ("x", 3)], "name string, node_ord int")
    asked = spark.createDataFrame([(1, "disruption at N10 hits Arm"), (2, "does harm reach N1?"), (3, "nothing here"), (4, None), (5, "")], "id int, question string")
    got = {r["id"]: (r["start"], r["companies"], r["target"]) for r in questions.link(asked, names).collect()}
    assert got[1] == ("N10", ["N1", "N10", "Arm"], "N1") and got[2] == ("Arm", ["Arm", "N1"], "N1") and got[3] == (None, [], None) and got[5] == (None, [], None)
    made = edges(spark)
    said = spark.createDataFrame([(1, "What does a disruption at A mean?"), (2, "zzz")], "id int, question string")
    rows = {r["id"]: r for r in questions.answer_questions(said, made).collect()}
    assert rows[2]["status"] == "NO_COMPANY" and rows[2]["context"] == questions.NO_EVIDENCE
    text_, svg = pipeline.ask(spark, made, "disruption at A to E")
    assert text_.first()["status"] == "OK" and svg.startswith("<svg") and "2-hop" in svg  # the D of "disruption" is the first other node mentioned
    long = spark.createDataFrame([(1, ["A", "B"], [("A", "r", "B", None, "f", "y" * 501, "forward")])], f"n int, path array<string>, r array<{schemas.RELATIONSHIP}>")
    shown = long.select(questions.render_path(F.col("n"), F.col("path"), F.col("r")).alias("t")).first()["t"]
    assert "Confidence: not provided" in shown and "y" * 500 + "..." in shown and "y" * 501 not in shown


def test_layout(spark):
    paths = spark.createDataFrame([("S", ["S", "b", "d"]), ("S", ["S", "a", "c"]), ("S", ["S", "a", "e", "d"])], "start string, path array<string>")
    rows = {r["node"]: (r["hop"], r["layer_pos"], r["y"]) for r in layout.positions(paths).collect()}
    assert rows == {"S": (0, 0, 0.0), "a": (1, 0, 0.85), "b": (1, 1, -0.85), "c": (2, 0, 1.7), "e": (2, 1, 0.0), "d": (2, 2, -1.7)}
    assert layout.svg(layout.styled(layout.positions(paths.limit(0))), layout.path_edges(paths.limit(0)), "S") == ""


def test_evaluation(spark, tmp_path):
    made = edges(spark)
    cases = spark.createDataFrame([(["A", "B", "D", "E"],), (["A", "E"],)], "path array<string>")
    rows = pipeline.evaluate_paths(made, cases)
    assert [(r["path"], r["hop_count"], r["total_score"]) for r in rows.collect()] == [("A -> B -> D -> E", 3, 10)]
    assert evaluate.mean_score(rows).first()["average"] == "10.0"
    files.write_csv(rows, str(tmp_path / "r"))
    assert files.read_csv(spark, str(tmp_path / "r"), rows.schema.simpleString()[7:-1].replace(":", " ")).count() == 1
    bad = evaluate.rule_judge(spark.createDataFrame([(["A", "B"], [])], f"path array<string>, relationships array<{schemas.RELATIONSHIP}>")).first()
    assert bad["total_score"] == 2 and bad["unsupported_steps"] == ["A -> B"]
    reply = json.dumps({**dict.fromkeys(evaluate.PATH_ITEMS, 1), "unsupported_steps": ["x", "y"], "direction_errors": [], "explanation": "e"})
    judged = evaluate.model_judge(graph.retrieve_evidence(made, "A", 1, 1).withColumn("text", F.lit("t")), "text", evaluate.PATH_ITEMS, ("unsupported_steps", "direction_errors"), lambda: lambda prompt: reply)
    assert evaluate.path_rows(judged).select("total_score", "unsupported_steps").first() == (5, "x; y")
    assert evaluate.risk_rules(spark).count() == 3


GOOD = '{"triples":[{"head":"A","relation":"supplier_of","tail":"B","confidence":0.8}]}'


def test_responses(spark):
    cases = {GOOD: 1, f"```json\n{GOOD}\n```": 1, f"Here: {GOOD}": 1, f"{GOOD}\nNote: x": None, '{"triples":[{"head":"A"': None, "{'triples':[]}": None, "{}": 0, "[]": None, "": None}
    sent = spark.createDataFrame([("f", i, str(i), r, None) for i, r in enumerate(cases)], "source_file string, sent_pos int, sentence string, response string, error string")
    rows = responses.parse(sent).orderBy("sent_pos").collect()
    assert [None if r["error"] else len(r["triples"] or []) for r in rows] == list(cases.values())
    odd = '{"triples":[{"head":" A ","relation":"friend_of","tail":"B","confidence":1.7},{"head":"A","relation":"customer_of","tail":"B"},{"head":null,"relation":"supplier_of","tail":"B"},{"head":"x","relation":null,"tail":"y","confidence":"high"}]}'
    got = responses.triples(responses.parse(spark.createDataFrame([("f", 0, "s", odd, None)], sent.schema))).collect()
    assert {(r["head"], r["relation"], r["tail"], r["confidence"]) for r in got} == {("A", "INVALID:friend_of", "B", 1.0), ("B", "supplier_of", "A", 0.5), ("x", "INVALID:", "y", 0.5)}


def test_providers(spark):
    waits = []
    tried = iter([RuntimeError("429 try again in 1m2.5s"), RuntimeError("429"), "ok"])

    def call(prompt):
        x = next(tried)
        if isinstance(x, Exception):
            raise x
        return x

    assert responses.with_retries(call, "p", sleep=waits.append) == ("ok", None) and waits == [67.5, 4.0]

    def refuse(prompt):
        raise RuntimeError("down")

    assert responses.with_retries(refuse, "p")[1] == "API error: down"
    filings = spark.createDataFrame([("INTC_2023.txt", "Acme is a customer of Bolt since many years and more. " * 3)], "source_file string, text string")
    found, errors = pipeline.extract_by_model(filings, lambda: lambda prompt: GOOD)
    assert found.count() == 3 and errors.count() == 0
    assert pipeline.extract_by_model(filings, None)[0].count() == 0
    asked = responses.prompts(spark.createDataFrame([("f", 0, "s", None)], "source_file string, sent_pos int, sentence string, filer string"))
    known = asked.select("prompt_hash", F.lit(GOOD).alias("response"))
    assert responses.triples(responses.parse(responses.replay(asked, known))).count() == 1


def counting(log, reply=GOOD):
    """A provider that notes each call in a file."""

    def call(prompt):
        with open(log, "a") as f:
            f.write(prompt.replace("\n", " ") + "\n")
        if "bad" in prompt:
            raise RuntimeError("down")
        return reply

    return lambda: call


def test_each_prompt_is_called_once(spark, tmp_path):
    log, path = str(tmp_path / "log"), str(tmp_path / "ledger")
    rows = [(i, f"prompt {i % 9}") for i in range(40)] + [(99, None), (100, "bad")]
    asked = spark.createDataFrame(rows, "id int, prompt string").repartition(5)

    def run():
        got = responses.complete(asked, counting(log), path, rate=None, callers=3).collect()
        assert len(got) == 42 and all((r["response"], r["error"]) == (GOOD, None) for r in got if r["id"] < 40)
        assert {r["id"]: (r["response"], r["error"]) for r in got if r["id"] >= 40} == {99: (None, None), 100: ("", "API error: down")}
        with open(log) as f:
            return Counter(line.strip() for line in f)

    assert run() == {f"prompt {k}": 1 for k in range(9)} | {"bad": 1}
    assert run() == {f"prompt {k}": 1 for k in range(9)} | {"bad": 2}  # errors are asked again
    assert ledger.calls(spark, path).count() == 11 and ledger.answers(spark, path).count() == 10
    assert not list((tmp_path / "ledger" / "ahead").glob("*.json"))
    # Another scope is another answer; what a broken run left is used, but for the line that it didn't end.
    keys = spark.range(1).select(ledger.key_of(F.lit("prompt 0"), "m").alias("a"), ledger.key_of(F.lit("prompt 1"), "m").alias("b")).first()
    (tmp_path / "ledger" / "ahead" / "old.json").write_text(json.dumps({"key": keys["a"], "response": GOOD, "error": None, "end": 1}) + "\n" + '{"key": "' + keys["b"] + '", "response": "half')
    responses.complete(asked.filter("id < 40"), counting(log), path, scope="m", rate=None, callers=3).count()
    with open(log) as f:
        assert Counter(line.strip() for line in f) == {"prompt 0": 1, "bad": 2} | {f"prompt {k}": 2 for k in range(1, 9)}


def test_attempts_skip_what_earlier_ones_wrote(tmp_path):
    (tmp_path / "ahead").mkdir()
    one = ledger._Ahead(f"file://{tmp_path}/ahead", "run-3-", 2)
    for k in "abc":
        one.write(k, "r", None)
    (tmp_path / "ahead" / "run-3-torn.json").write_text('{"key": "d", "respo')
    (tmp_path / "ahead" / "run-31-x.json").write_text(json.dumps({"key": "e"}) + "\n")
    assert ledger._Ahead(f"file://{tmp_path}/ahead", "run-3-", 2).done() == {"a", "b", "c"}
    one.close()


@pytest.mark.parametrize("callers", [1, 64])
def test_one_rate_for_all_tasks(callers):
    """Tasks with clocks of their own, some of them late: in no stretch of ten seconds are there more than 10 * rate calls and one
    more for each task."""
    rate, made = 4.0, []
    for mine in range(callers):
        now = [1000.0 + (30 if mine % 5 == 1 else 0)]  # every fifth starts late

        def sleep(seconds, now=now):
            now[0] += seconds

        pace = ledger.Pace(rate, callers, mine, 1000.0, lambda now=now: now[0], sleep)
        for _ in range(640 // callers):
            pace.wait()
            made.append(now[0])
            now[0] += 0.1
    made.sort()
    assert max(sum(1 for t in made[i:] if t < s + 10) for i, s in enumerate(made)) <= 10 * rate + callers
    assert len(made) / (made[-1] - made[0]) <= rate + 0.5


def test_a_pipeline_pays_once(spark, tmp_path):
    log, folder, out = str(tmp_path / "log"), tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for name in ("AMD_2023.txt", "MU_2023.txt"):
        (folder / name).write_text(f"In most years Acme Works is a customer of Bolt Labs and of others. {name} says that it is a customer of wafers and more of it.", "utf-8")
    pipeline.run(spark, str(folder), out, make_provider=counting(log))
    pipeline.run(spark, str(folder), out, make_provider=counting(log))
    pipeline.extract_new(spark, str(folder), out, counting(log))
    shutil.rmtree(f"{out}/checkpoint")  # the stream begins anew and takes the same files again
    pipeline.extract_new(spark, str(folder), out, counting(log))
    with open(log) as f:
        lines = f.read().splitlines()
    assert len(lines) == len(set(lines)) == 4


def token(i, text_, lemma, pos, dep, head, idx):
    return {"i": i, "idx": idx, "text": text_, "lemma": lemma, "pos": pos, "dep": dep, "head": head}


def annotated(spark, sentence, tokens, ents, filer="Intel"):
    made = []
    at = 0
    for i, (word, lemma, pos, dep, head) in enumerate(tokens):
        at = sentence.index(word, at)
        made.append(token(i, word, lemma, pos, dep, head, at))
        at += len(word)
    spans = [{"text": e, "start": sentence.index(e), "end": sentence.index(e) + len(e), "label": kind} for e, kind in ents]
    return spark.createDataFrame([("INTC_2023.txt", 0, sentence, made, spans, filer)], f"{schemas.ANNOTATED}, filer string")


def heads(df):
    return [(r["head"], r["relation"], r["tail"], r["confidence"]) for r in df.collect()]


def test_rules(spark):
    verb = annotated(spark, "Acme supplies chips to Bolt", [("Acme", "Acme", "PROPN", "nsubj", 1), ("supplies", "supply", "VERB", "ROOT", 1), ("chips", "chip", "NOUN", "dobj", 1), ("to", "to", "ADP", "prep", 1), ("Bolt", "Bolt", "PROPN", "pobj", 3)], [("Acme", "ORG"), ("Bolt", "ORG")])
    assert heads(rules.extract(verb)) == [("Acme", "supplier_of", "Bolt", 0.75)]
    swap = annotated(spark, "Acme acquired Bolt", [("Acme", "Acme", "PROPN", "nsubj", 1), ("acquired", "acquire", "VERB", "ROOT", 1), ("Bolt", "Bolt", "PROPN", "dobj", 1)], [("Acme", "ORG"), ("Bolt", "ORG")])
    assert heads(rules.extract(swap)) == [("Bolt", "subsidiary_of", "Acme", 0.65)]
    own = annotated(spark, "our customers include Bolt", [("our", "our", "PRON", "poss", 1), ("customers", "customer", "NOUN", "nsubj", 2), ("include", "include", "VERB", "ROOT", 2), ("Bolt", "Bolt", "PROPN", "dobj", 2)], [("Bolt", "ORG")])
    assert heads(rules.extract(own)) == [("Intel", "supplier_of", "Bolt", 0.85)]
    such = annotated(spark, "We rely on makers such as Bolt", [("We", "we", "PRON", "nsubj", 1), ("rely", "rely", "VERB", "ROOT", 1), ("on", "on", "ADP", "prep", 1), ("makers", "thing", "NOUN", "pobj", 2), ("such", "such", "ADJ", "amod", 3), ("as", "as", "ADP", "prep", 3), ("Bolt", "Bolt", "PROPN", "appos", 3)], [("Bolt", "ORG")])
    assert heads(rules.extract(such)) == [("Intel", "depends_on", "Bolt", 0.78)]
    junk = annotated(spark, "Acme supplies the Exhibit Section", [("Acme", "Acme", "PROPN", "nsubj", 1), ("supplies", "supply", "VERB", "ROOT", 1)], [("Acme", "ORG"), ("Exhibit Section", "ORG")])
    assert heads(rules.extract(junk)) == []
    twin = annotated(spark, "Acme rivals Bolt as a rival of Bolt", [("Acme", "Acme", "PROPN", "nsubj", 1), ("rivals", "rival", "VERB", "ROOT", 1), ("Bolt", "Bolt", "PROPN", "dobj", 1), ("as", "as", "ADP", "prep", 1), ("a", "a", "DET", "det", 5), ("rival", "rival", "NOUN", "pobj", 3)], [("Acme", "ORG"), ("Bolt", "ORG")])
    assert heads(rules.extract(twin)) == [("Acme", "competitor_of", "Bolt", 0.8)]


def test_nearest(spark):
    ents = [("Alpha", 0, 5, "ORG"), ("Beta", 10, 14, "GPE"), ("Gamma", 60, 65, "GPE"), ("Delta", 70, 75, "PRODUCT")]
    for rows, before, after in ((ents, "Alpha", "Delta"), (ents[1:3], "Beta", "Gamma"), ([], None, None)):
        made = spark.createDataFrame([(rows,)], f"ents {schemas.ENTITIES}")
        assert made.select(rules.nearest_before(F.col("ents"), F.lit(50)).alias("b"), rules.nearest_after(F.col("ents"), F.lit(50)).alias("a")).first() == (before, after)


@pytest.mark.parametrize("after", [False, True])
def test_nearest_of_a_hot_key(spark, after):
    """One user has half of all rows: they lie in several ranges, and the nearest rows come over their edges."""
    rng = random.Random(5)
    users = ["hot"] * 600 + [f"u{i % 40}" for i in range(560)] + [None] * 40
    left = [(u, rng.randint(0, 900), i) for i, u in enumerate(users) if rng.random() < 0.5]
    right = [(u, rng.randint(0, 900), i) for i, u in enumerate(users) if rng.random() < 0.1]
    frames = [spark.createDataFrame(rows, f"u string, t int, {n} int") for rows, n in ((left, "i"), (right, "j"))]
    want = []
    for u, t, i in left:
        near = [(s, j) for v, s, j in right if v == u and u is not None and (s >= t if after else s <= t)]
        best = (min if after else max)(near, default=None)
        want.append((i, best[1] if best else None))
    got = asof.nearest(*frames, "u", "t", ["j"], after=after)
    assert sorted((r["i"], r["near_j"]) for r in got.collect()) == sorted(want)
    parts = ranges.ranged(frames[0], [F.col("u"), F.col("t")], "parts")
    assert parts.filter("u = 'hot'").select("__range").distinct().count() > 1


def test_running_values_over_ranges(spark):
    rng = random.Random(6)
    rows = [(rng.choice("aaab"), i, rng.choice([None, 0.1, 0.5, 0.9])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, x double").repartition(3)
    for how in ("max", "last"):
        got = {r["i"]: r["o"] for r in ranges.running(ranges.ranged(df, [F.col("k"), F.col("i")], "r"), ["k"], [F.col("i")], "x", how, "o").collect()}
        for k, i, _ in rows:
            before = [x for key, j, x in rows if key == k and j < i and x is not None]
            assert got[i] == ((max(before) if how == "max" else before[-1]) if before else None)


def test_points_in_spans(spark):
    rng = random.Random(7)
    tokens = [(s, i, rng.randint(-40, 2000)) for s in range(6) for i in range(60)]
    ents = [(s, k, a, a + rng.choice([-3, 0, 1, 2, 3, 4, 5, 31, 32, 33, 700, 5000])) for s in range(5) for k in range(25) for a in [rng.randint(-50, 1500)]]
    frames = spark.createDataFrame(tokens, "sent int, i int, idx int"), spark.createDataFrame(ents, "sent int, k int, s int, e int")
    got = spans.containing(*frames, key=["sent", "i"], by=["sent"], at="idx", start="s", end="e", order=["k"], take=["k"])
    want = {(s, i): min((k for t, k, a, b in ents if t == s and a <= x < b), default=None) for s, i, x in tokens}
    assert {(r["sent"], r["i"]): r["k"] for r in got.collect()} == want and got.count() == len(tokens)
    none = spans.containing(frames[0], frames[1].limit(0), key=["sent", "i"], by=["sent"], at="idx", start="s", end="e", order=["k"], take=["k"])
    assert {r["k"] for r in none.collect()} == {None}


def test_names_of_all_lengths(spark):
    """Names of 2 to 60 letters, many with one beginning, in texts that name one of them very often."""
    rng = random.Random(8)
    names = ["ab", "the", "the b", "b" * 60, "x y", ""] + ["the " + "".join(rng.choice("abc ") for _ in range(rng.randint(1, 40))) for _ in range(60)]
    texts = [(i, " ".join(rng.choice(names) for _ in range(rng.randint(0, 6))) + "the" * (i % 3)) for i in range(80)] + [(99, None), (98, "")]
    frames = spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame([(n, k) for k, n in enumerate(sorted(set(names)))], "name string, k int")
    got = spans.occurrences(frames[0], "t", ["id"], frames[1], "name")
    want = {(i, n): t.index(n) + 1 for i, t in texts if t for n in set(names) if n and n in t}
    assert {(r["id"], r["name"]): r["pos"] for r in got.collect()} == want and got.columns == ["id", "name", "k", "pos"]


def test_hot_names_are_joined_by_broadcast(spark):
    rows = [("we", "AC")] * 400 + [("Acme Corp.", "AC")] * 300 + [(None, "AC"), ("", "AC"), ("Ghost Notes", "AC"), ("we", "NO")] + [(f"Name {i} Ltd", "AC") for i in range(30)]
    made = spark.createDataFrame([(n, t, i) for i, (n, t) in enumerate(rows)], "n string, filer string, i int").repartition(4)
    small = resolve.Names(made.select(F.col("n").alias("name")), LEX)
    large = resolve.Names(made.select(F.col("n").alias("name")), LEX, small=0, share=0.05)
    assert small.small and not large.small and large.rows.filter(F.col("n") > large.hot).count() == 2
    one, two = ({r["i"]: r["x"] for r in names.attach(made, "n", "x").collect()} for names in (small, large))
    assert one == two and len(one) == len(rows)
    assert {one[i]["entity"] for i in range(400, 700)} == {"Acme"} and one[0]["pronoun"] and one[700] is None and one[701]["entity"] is None


def test_best_of_a_hot_triple(spark):
    rng = random.Random(9)
    rows = [("A", "supplier_of", "B" if rng.random() < 0.7 else f"C{rng.randint(0, 5)}", rng.choice([0.4, 0.5, 0.9]), "x", 0, i, None) for i in range(400)]
    df = spark.createDataFrame(rows, "head string, relation string, tail string, confidence double, extractor string, extractor_ord int, ord int, reason string").repartition(6)
    best, first, kept = {}, {}, 0
    for _, _, t, c, _, _, i, _ in rows:
        first.setdefault(t, i)
        if t not in best or c > best[t][0]:
            best[t], kept = (c, i), kept + 1
    got = merge.keep_best(df).collect()
    assert {r["tail"]: (r["confidence"], r["ord"], r["first_ord"]["ord"]) for r in got} == {t: (*best[t], first[t]) for t in best}
    assert merge.kept_counts(df).first()["kept"] == kept


def test_plain_annotator(spark):
    sents = spark.createDataFrame([("INTC_2023.txt", 0, "In 2023 Acme Works supplies wafers to Bolt Labs every week")], schemas.SENTENCES)
    found = rules.extract(annotate.annotate(sents).withColumn("filer", F.lit("Intel")))
    assert heads(found) == [("Acme Works", "supplier_of", "Bolt Labs", 0.75)]
    plain = annotate.PlainAnnotator()
    said = ["He SUPPLIES it", "they relied on it", "nothing of that", "suppliers'", "re-uses", "unused", "alliances", "competing", ""]
    made = spark.createDataFrame([("f", i, s) for i, s in enumerate(said)], schemas.SENTENCES)
    kept = {r["sentence"] for r in made.filter(plain.may_matter(F.col("sentence"))).collect()}
    assert {s for s in said if any(t["pos"] in ("VERB", "NOUN") for t in plain(s)[0])} <= kept and "nothing of that" not in kept and "unused" not in kept and len(kept) < len(said)


def test_files_and_pipeline(spark, tmp_path):
    folder = tmp_path / "in"
    assert files.filings(spark, str(folder)).count() == 0
    folder.mkdir()
    assert files.filings(spark, str(folder)).count() == 0
    (folder / "NVDA_2023.txt").write_text("In most years Advanced Micro Devices supplies wafers to Broadcom Inc. The rest of it is dull and long enough to stay.", "utf-8")
    (folder / "other.txt").write_text("x")
    assert [r["source_file"] for r in files.filings(spark, str(folder)).collect()] == ["NVDA_2023.txt"]
    out = pipeline.run(spark, str(folder), str(tmp_path / "out"))
    assert [(r["head"], r["relation"], r["tail"]) for r in out["merged"].collect()] == [("AMD", "supplier_of", "Broadcom")]
    again = files.triples(spark, str(tmp_path / "out" / "merged_json"))
    assert again.count() == 1 and out["per_file"].first()["triples"] == 1
    with pytest.raises(FileNotFoundError):
        files.triples(spark, str(tmp_path / "none.json"))
    assert files.triples(spark, str(tmp_path / "none.json"), missing_ok=True).count() == 0
    (tmp_path / "bad.json").write_text('{"total": 1, "triples": null}')
    with pytest.raises(ValueError):
        files.triples(spark, str(tmp_path / "bad.json"))


def test_stream_of_files(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    for name in ("A_2023.txt", "B_2023.txt", None):
        if name:
            (folder / name).write_text("text")
        incremental.process_new(spark, str(folder), str(tmp_path / "ck"), lambda df, n: seen.append([r["source_file"] for r in df.collect()]))
    assert [s for s in seen if s] == [["A_2023.txt"], ["B_2023.txt"]]
    filings = spark.createDataFrame([("a", "x"), ("b", "y")], "source_file string, text string")
    assert [r["source_file"] for r in incremental.pending(filings, filings.filter("source_file = 'a'")).collect()] == ["b"]


def test_writes(spark, tmp_path):
    rows = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", "h")], "source_file string, head string")
    files.write_by_file(rows, str(tmp_path / "t"))
    done = spark.createDataFrame([("a",), ("c",)], "source_file string")  # c has no triple any more
    for _ in range(2):
        files.write_by_file(spark.createDataFrame([("a", "new")], rows.schema), str(tmp_path / "t"), done, 1)
        assert {(r["source_file"], r["head"]) for r in files.stored_triples(spark, str(tmp_path / "t")).collect()} == {("a", "new"), ("b", "h")}
    places = [str(tmp_path / "x"), str(tmp_path / "y")]
    files.write_copies(rows, places, lambda df, p: df.write.parquet(p))
    assert [spark.read.parquet(p).count() for p in places] == [3, 3]
    bad = spark.createDataFrame([("s", "e", "f")], schemas.ERRORS)
    for batch in (0, 0, 1):  # the first batch comes twice
        files.write_errors(bad if batch == 0 else bad.withColumn("source_file", F.lit("g")), str(tmp_path / "e"), batch=batch)
    assert sorted(r["source_file"] for r in files.error_store(spark, str(tmp_path / "e")).read().collect()) == ["f", "g"]


def test_store_of_many_files(spark, tmp_path):
    """10,000 filings give a bounded number of files; a broken attempt leaves nothing that is read; old versions go."""
    path = str(tmp_path / "s")
    store = BucketStore(spark, path, ("source_file",), 8)
    rows = spark.range(10_000).select(F.concat(F.lit("f"), "id").alias("source_file"), F.lit(0).alias("x"))
    with pytest.raises(FileNotFoundError):
        store.read()
    store.replace(rows, rows, 0)
    assert len(list((tmp_path / "s" / "data").glob("*/*/*.parquet"))) <= 8 and store.read().count() == 10_000
    broken = tmp_path / "s" / "data" / "1-broken" / "__bucket=0"
    broken.mkdir(parents=True)
    (broken / "x.parquet").write_text("half")
    for batch in range(1, 5):
        some = rows.filter(F.col("source_file") == f"f{batch}").withColumn("x", F.lit(batch))
        BucketStore(spark, path, ("source_file",)).replace(some, some, batch)
        store = BucketStore(spark, path, ("source_file",))
        store.replace(some, some, batch)  # comes again
    assert store.read().count() == 10_000 and {r["source_file"]: r["x"] for r in store.read().filter("x > 0").collect()} == {f"f{k}": k for k in range(1, 5)}
    assert len(list((tmp_path / "s" / "data").glob("*"))) < 12
    store.replace_all(rows.limit(3), None)
    assert BucketStore(spark, path, ("source_file",)).read().count() == 3


def test_merged_state_equals_a_full_merge(spark, tmp_path):
    """Files in any order, some twice: the state is what a merge of all gives."""
    rng = random.Random(3)
    names = ["Acme Corp.", "bolt", "Cog Works", "Dyno Labs", "we", "AB", None, "Ghost Notes"]
    rows = [(rng.choice(names), rng.choice(["supplier_of", "partner_of", "bad"]), rng.choice(names), rng.choice([None, 0.5, 0.7, 0.7]), f"AC_{i % 12}.txt", "s", i, rng.choice(["a", "b"])) for i in range(400)]
    df = spark.createDataFrame(rows, "head string, relation string, tail string, confidence double, source_file string, source_sentence string, ord int, extractor string").withColumn("extractor_ord", (F.col("extractor") == "b").cast("int"))
    want = {tuple(r[c] for c in ("head", "relation", "tail", "confidence", "ord", "first_ord")) for r in merge.keep_best(merge.judge(df, LEX)).collect()}
    store = BucketStore(spark, str(tmp_path / "state"), merge.KEY, 4)
    order = [[3, 4, 5], [0, 11, 7], [3, 4, 5], [1, 2], [10, 9, 8, 6], [6, 0]]
    for batch, some in enumerate(order):
        store.merge(merge.state_rows(merge.judge(df.filter(F.col("source_file").isin([f"AC_{k}.txt" for k in some])), LEX)), merge.combine, batch)
    got = {tuple(r[c] for c in ("head", "relation", "tail", "confidence", "ord", "first_ord")) for r in store.read().collect()}
    assert got == want and want


@pytest.mark.parametrize("limit", [None, 2])
def test_paths_to_targets(spark, limit):
    """Random graphs against all simple paths; a dead end is never entered, nor a node too far from its target."""
    rng = random.Random(11)
    names = [f"n{i}" for i in range(9)]
    pairs = {(a, b) for a in names for b in names if a != b and rng.random() < 0.25} | {("n0", "dead"), ("dead", "end")}
    made = spark.createDataFrame([(a, b, "supplier_of", 0.5, "f", "s", i) for i, (a, b) in enumerate(sorted(pairs))], "src string, dst string, relation string, confidence double, source_file string, source_sentence string, edge_ord int")
    wanted = [("n0", "n5"), ("n0", "n7"), ("n3", "n0"), ("n1", "end"), ("n2", "n2"), (None, "n1"), ("n4", "nowhere")]
    got = graph.paths_to(made, spark.createDataFrame(wanted, "start string, target string"), 4, limit).collect()
    every = graph.cascade_paths(made, max_hops=4).collect()
    want = []
    for s, t in wanted:
        if s and s != t:
            found = sorted((r["hops"], r["path"]) for r in every if r["start"] == s and r["path"][-1] == t)
            want += [(s, t, p) for _, p in found[:limit]]
    assert sorted((r["start"], r["target"], r["path"]) for r in got) == sorted(want) and want
    risk = graph.risk_adjacency(made)
    far = graph.distances_to(risk, spark.createDataFrame([("n5",)], "target string"), 4).collect()
    assert {r["node"] for r in far}.isdisjoint({"dead", "end"}) and {r["distance"] for r in far if r["node"] == "n5"} == {0}


def test_http_provider():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            busy = asked["messages"][-1]["content"] == "busy"
            self.send_response(429 if busy else 200)
            self.end_headers()
            self.wfile.write(b"try again in 0m1s" if busy else json.dumps({"choices": [{"message": {"content": asked["model"]}}]}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    call = responses.HttpProvider(f"http://127.0.0.1:{server.server_port}/", "k", "m")
    assert call("hi") == "m"
    waits = []
    assert responses.with_retries(call, "busy", 2, waits.append)[1].startswith("API error: 429") and waits == [6.0]
    server.shutdown()
    with pytest.raises(ValueError):
        responses.HttpProvider("http://x", "", "m")


def test_answers_and_new_files(spark, tmp_path):
    asked = spark.createDataFrame([(1, "direct", "What does a disruption at C mean?")], "id int, type string, question string")
    answers = questions.answer_questions(asked, edges(spark))
    reply = json.dumps({**dict.fromkeys(evaluate.ANSWER_ITEMS, 2), "unsupported_claims": [], "direction_errors": ["a"], "explanation": ""})
    row = pipeline.evaluate_answers(answers, lambda: lambda prompt: reply).first()
    assert row["total_score"] == 10 and row["start_company"] == "C" and row["direction_errors"] == "a"
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("AMD_2023.txt", "MU_2023.txt"):
        (folder / name).write_text("In most years Acme Works supplies wafers to Bolt Labs and others. The rest of it is dull and long.", "utf-8")
        pipeline.extract_new(spark, str(folder), str(tmp_path / "out"), lambda: lambda prompt: "no json")
    found = files.stored_triples(spark, str(tmp_path / "out" / "rule_triples"))
    assert sorted(r["source_file"] for r in found.collect()) == ["AMD_2023.txt", "MU_2023.txt"]


def test_complete_graph_with_limit(spark):
    """40 nodes, all linked, 4 hops: 25 paths of each start, though there are over two million of each."""
    names = [f"N{i:02}" for i in range(40)]
    rows = [(a, "supplier_of", b, 0.5, "f", "s", i * 40 + j) for i, a in enumerate(names) for j, b in enumerate(names)]
    table = graph.edges(spark.createDataFrame(rows, "head string, relation string, tail string, confidence double, source_file string, source_sentence string, edge_ord int"))
    got = graph.first_paths(graph.cascade_paths(table, None, 4, 25), 25).collect()
    assert len(got) == 40 * 25 and {r["hops"] for r in got} == {1}
    deep = graph.first_paths(graph.cascade_paths(table, "N00", 4, 60), 60).collect()
    assert [list(r["path"]) for r in sorted(deep, key=lambda r: r["rank"])] == [["N00", n] for n in names[1:]] + [["N00", "N01", n] for n in names[2:23]]


def test_places(spark):
    rows = [(f"h{i % 7}", "r", f"t{i}", (i % 5) / 5, i) for i in range(200)]
    table = spark.createDataFrame(rows, "head string, relation string, tail string, confidence double, first_ord int")
    want = sorted(rows, key=lambda r: (-r[3], r[0], r[1], r[4]))
    assert [tuple(r)[:5] for r in sorted(merge.placed(table).collect(), key=lambda r: r["place"])] == want
    assert merge.placed(table.limit(0)).count() == 0


def test_evaluation_drivers(spark, tmp_path):
    rows = [("TSMC", "supplier_of", "Broadcom"), ("TSMC", "supplier_of", "AMD"), ("Broadcom", "supplier_of", "Huawei"), ("UMC", "supplier_of", "AMD"), ("TSMC", "depends_on", "AMD"), ("GLOBALFOUNDRIES", "depends_on", "UMC"), ("GLOBALFOUNDRIES", "supplier_of", "AMD")]
    table = graph.edges(spark.createDataFrame([(*r, 0.8, "f", "s", i) for i, r in enumerate(rows)], "head string, relation string, tail string, confidence double, source_file string, source_sentence string, edge_ord int"))
    found, mean = drivers.evaluate_path_cases(table, str(tmp_path / "paths"))
    assert found.count() == 5 and mean.first()["average"] == "10.0"
    assert files.read_csv(spark, str(tmp_path / "paths"), ", ".join(f"{c} string" for c in evaluate.PATH_COLUMNS)).count() == 5
    with pytest.raises(ValueError, match="Path not found: TSMC -> UMC"):
        drivers.evaluate_path_cases(table, str(tmp_path / "none"), cases=spark.createDataFrame([(["TSMC", "UMC"],)], "path array<string>"))
    found, mean = drivers.evaluate_question_cases(table, str(tmp_path / "answers"), lambda: lambda prompt: "TSMC may hit Broadcom, AMD or Huawei\non 9 hops.")
    got = {r["question_id"]: r for r in found.collect()}
    assert sorted(got) == ["Q1", "Q2", "Q3", "Q4", "Q5"] and got["Q1"]["answer"].startswith("TSMC may") and got["Q1"]["unsupported_claims"] == "9 hops" and got["Q1"]["total_score"] == 8
    again = files.read_csv(spark, str(tmp_path / "answers"), ", ".join(f"{c} string" for c in evaluate.ANSWER_COLUMNS))
    assert again.count() == 5 and again.filter("question_id = 'Q4' AND answer LIKE '%hops.'").count() == 1
    reply = json.dumps({**dict.fromkeys(evaluate.ANSWER_ITEMS, 1), "unsupported_claims": [], "direction_errors": [], "explanation": ""})
    assert drivers.evaluate_question_cases(table, str(tmp_path / "judged"), None, lambda: lambda prompt: reply)[1].first()["average"] == "5.0"
    with pytest.raises(ValueError, match="No relationships"):
        drivers.evaluate_question_cases(table, str(tmp_path / "x"), cases=spark.createDataFrame([("a", "t", "Nobody?")], "id string, type string, question string"))
    assert "Traversal: reverse" in drivers.demonstration(table, "UMC").filter("rank = 2").first()["text"]


def test_copies_and_new_only(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "NVDA_2023.txt").write_text("In most years Advanced Micro Devices supplies wafers to Broadcom Inc. The rest of it is dull and long enough to stay.", "utf-8")
    outs = [str(tmp_path / x) for x in "ab"]
    drivers.rules_to_copies(spark, str(folder), outs)
    assert [spark.read.parquet(o).count() for o in outs] == [1, 1]
    pipeline.extract_new(spark, str(folder), str(tmp_path / "out"))
    found = pipeline.merged_results(spark, str(folder), str(tmp_path / "out"))
    assert [(r["head"], r["relation"], r["tail"]) for r in found["merged"].collect()] == [("AMD", "supplier_of", "Broadcom")]
    answer, picture = pipeline.ask(spark, found["edges"], "What if a disruption at AMD?", lambda: lambda prompt: "By a model.")
    assert answer.first()["answer"] == "By a model." and picture.startswith("<svg")


def test_rules_make_each_value_once(spark):
    """A value named several times is made once, and only triggers are rows that carry their sentence."""
    drawn = spark.range(200).select(rules.once(F.rand(3), lambda v: F.struct(v.alias("a"), v.alias("b"))).alias("x"))
    assert drawn.filter("x.a <> x.b").isEmpty()
    plan = rules.extract(catalog._parsed_sentences(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(filter(tokens" in plan
