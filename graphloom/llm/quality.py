"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Every row gets the base figures that its reports need. The rules beyond them run in one CASE: a row that a rule rejects
meets no later rule. On a sample each rule's time and the rows that it rejects are measured, and the next rule is always the one that
rejects most of what is left per second; the order sets the cost, never the result.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, table

_SYMBOLS = "#*$%&|<>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def count_of(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != "")


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of each three words in a row; null where there are fewer."""
    return F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))


def covered_words(hashes: Column) -> Column:
    """Words in windows of three that a text has twice or more, from window_hashes().

    Sorting (hash, position) brings equal windows together; each such window covers its word and the two after it, less
    what the next such window covers.
    """

    def positions(pairs: Column) -> Column:
        def again(p: Column, k: Column) -> Column:
            before = F.when(k > 0, F.get(pairs, k - 1)["h"])
            return (F.coalesce(before == p["h"], F.lit(False))) | F.coalesce(F.get(pairs, k + 1)["h"] == p["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(pairs, again), lambda p: p["i"]))

    def covered(at: Column) -> Column:
        parts = F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3))).cast("long"))
        return F.aggregate(parts, F.lit(0).cast("long"), lambda a, b: a + b)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)  # false or null for most texts, which are then not sorted
    return F.when(repeats, _let(_let(pairs, positions), covered)).otherwise(F.lit(0).cast("long"))


#: Rules beyond the base, on `text` and the base figures; true rejects.
RULES: dict[str, Column | Callable[[], Column]] = {
    "symbols": lambda: F.col("n_symbols") * 10 > F.col("n_words"),
    "exclamations": lambda: count_of(F.col("text"), "!") * 5 > F.col("n_words"),
    "capitals": lambda: F.regexp_count("text", F.lit(r"\p{Lu}")) * 2 > F.regexp_count("text", F.lit(r"\p{L}")),
    "lines": lambda: F.col("n_dup_lines") * 10 > F.col("n_lines") * 3,
    "digits": lambda: F.regexp_count("text", F.lit("[0-9]")) * 10 > F.col("word_chars") * 3,
    "links": lambda: F.regexp_count("text", F.lit("https?://")) * 10 > F.col("n_words"),
    "long_words": lambda: F.regexp_count("text", F.lit(SPACE_CLASS.replace("[", "[^") + "{60,}")) * 20 > F.col("n_words"),
    "cut_lines": lambda: F.regexp_count("text", F.lit(r"\.\.\.\n")) * 10 > F.col("n_lines") * 3,
    "word_length": lambda: (F.col("word_chars") * 2 < F.col("n_words") * 5) | (F.col("word_chars") > F.col("n_words") * 12),
}


def figures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the base figures of each row."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACES, "") != "")
    # Each value that an array function's body uses is bound by _let: named by a column, it would be made again for each element.
    of_words = _let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), _let(window_hashes(w), covered_words).alias("twice")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("twice")))
    made = read.select("doc_id", "text", of_words.alias("words"), of_lines.alias("lines"))
    return made.select(
        "doc_id",
        "text",
        F.col("words.n").alias("n_words"),
        F.char_length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        count_of(F.col("text"), _SYMBOLS).cast("long").alias("n_symbols"),
        F.col("lines.twice").cast("long").alias("n_dup_lines"),
        F.col("lines.n").alias("n_lines"),
        F.coalesce("words.twice", F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def best_order(names: list[str], rejected: dict[int, int], cost: dict[str, float]) -> list[str]:
    """The rules one after another, each the one that rejects most of what those before it leave, for what it costs. rejected: how many
    rows each set of rules (bits, by place in names) rejects; ties go to the cheaper, then to the earlier rule."""
    left, out = dict(rejected), []
    while len(out) < len(names):
        gain = {name: sum(n for bits, n in left.items() if bits >> i & 1) for i, name in enumerate(names) if name not in out}
        best = min(gain, key=lambda name: (-gain[name] / cost[name], cost[name], names.index(name)))
        out.append(best)
        left = {bits: n for bits, n in left.items() if not bits >> names.index(best) & 1}
    return out


def expected_cost(order: list[str], names: list[str], rejected: dict[int, int], cost: dict[str, float]) -> float:
    """Seconds that a cascade in this order takes over the sample."""
    total, left = 0.0, dict(rejected)
    for name in order:
        total += cost[name] * sum(left.values())
        left = {bits: n for bits, n in left.items() if not bits >> names.index(name) & 1}
    return total


def measured(docs: DataFrame, rules: dict[str, Callable[[], Column]], *, sample_rows: int = 2000, seed: int = 3, copies: int = 4) -> tuple[dict[int, int], dict[str, float]]:
    """Over a sample of about sample_rows rows, whatever the input's size: how many rows each set of rules rejects, and the seconds
    that each rule takes for a row. A rule is timed over `copies` of each row in one job, the better of two; what the job takes
    without a rule is taken off."""
    n = docs.count()
    sample = table(figures(docs.sample(min(1.0, sample_rows / max(1, n)), seed)).filter(~base_failed()), "op3-sample")
    bits = sum((F.when(rule(), F.lit(1 << i)).otherwise(0) for i, rule in enumerate(rules.values())), F.lit(0))
    rejected = {r["bits"]: r["n"] for r in sample.groupBy(bits.alias("bits")).agg(F.count("*").alias("n")).collect()}  # no more rows than the sample
    # Each copy differs by its number, so that a rule is evaluated for each.
    many = sample.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn("text", F.concat("text", F.col("copy").cast("string")))

    def seconds(expression: Column) -> float:
        took = []
        for _ in range(2):
            began = time.perf_counter()
            many.agg(F.count_if(expression)).first()
            took.append(time.perf_counter() - began)
        return min(took)

    rows = max(1, sum(rejected.values())) * copies
    seconds(F.char_length("text") < 0)
    idle = seconds(F.char_length("text") < 0)
    return rejected, {name: max(1e-9, (seconds(rule()) - idle) / rows) for name, rule in rules.items()}


def order_of(docs: DataFrame, rules: dict[str, Callable[[], Column]], **sample) -> list[str]:
    """The rules' names, by rejections of what is left per second over a sample."""
    return best_order(list(rules), *measured(docs, rules, **sample)) if rules else []


def judged(docs: DataFrame, *, rules: dict[str, Callable[[], Column]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept of each row.

    Words are runs of other than space and U+0009 to U+000D. Null counts as empty: no words, so base_failed. Ids may be null
    or repeat; an empty table gives an empty result; other columns are not read.
    """
    rules = RULES if rules is None else rules
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    verdict = F.when(base_failed(), False)
    for name in order_of(named, rules):
        verdict = verdict.when(rules[name](), False)
    return figures(named).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), verdict.otherwise(True).alias("kept"))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
p AS (SELECT doc_id, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM w),
q AS (SELECT doc_id, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM q WHERE c IS NOT NULL),
s AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY doc_id),
f AS (SELECT doc_id, text, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             len(lines) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN s USING (doc_id)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > n_words) AND NOT (5 * len(regexp_extract_all(text, '!')) > n_words)
       AND NOT (2 * len(regexp_extract_all(text, '\p{Lu}')) > len(regexp_extract_all(text, '\p{L}')))
       AND NOT (10 * len(regexp_extract_all(text, '[0-9]')) > 3 * word_chars) AND NOT (10 * len(regexp_extract_all(text, 'https?://')) > n_words)
       AND NOT (20 * len(regexp_extract_all(text, '[^\x20\x09-\x0D]{60,}')) > n_words) AND NOT (10 * len(regexp_extract_all(text, '\.\.\.\n')) > 3 * n_lines)
       AND NOT (10 * n_dup_lines > 3 * n_lines) AND NOT (2 * word_chars < 5 * n_words OR word_chars > 12 * n_words) AS kept
FROM g
"""
