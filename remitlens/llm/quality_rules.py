"""Quality rules whose cutoffs are certified on labelled documents; DataFrame expressions only.

A rule rejects a document when a measure passes its cutoff. Candidate cutoffs are
fixed in advance. For each stratum, rule and candidate the labelled good documents
give a number of false rejections; the candidate is certified when an exact
binomial tail shows that its false rejection rate is at most the rule's share of
``risk``. All candidates of all rules and strata share ``confidence`` (Bonferroni),
so the strictest certified cutoff of each rule may be taken: with probability
1 - ``confidence`` no stratum loses more than ``risk`` of its good documents. A
stratum with too few labels certifies nothing and loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.llm.store import pinned

_SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS, MAX_REPEAT = 20, 30
MAX_STRATA = 10_000

#: rule -> (measure, unit, candidates from strict to lenient); rejected when factor * measure > candidate * unit.
RULES: dict[str, tuple[str, int, str, tuple[int, ...]]] = {
    "symbols": ("n_symbols", 1000, "n_words", (20, 50, 100, 150, 200, 300, 500, 1000, 2000)),
    "dup_lines": ("n_dup_lines", 1000, "n_lines", (50, 100, 150, 200, 250, 300, 350, 400, 500, 600, 800)),
    "repeats": ("n_repeat_words", 1000, "n_words", (50, 100, 150, 200, 250)),
    "long_words": ("word_chars", 100, "n_words", (550, 600, 650, 700, 750, 800, 900, 1000)),
}


def measures(docs: DataFrame, stratum: str) -> DataFrame:
    """(doc_id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) per row."""
    text = F.coalesce("text", F.lit(""))
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    cut = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
        F.array_remove(F.split(text, _SPACE, -1), "").alias("words"),
        F.filter(F.split(text, "\n", -1), has_word).alias("lines"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).alias("n_symbols"),
    )
    counted = cut.select(
        "doc_id", "stratum", "n_symbols",
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    starts = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), F.col("n_words") - WINDOW))
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get("hashes", i + j) for j in range(WINDOW)]))
    hashed = counted.withColumn("windows", windows).drop("hashes")
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = hashed.withColumn(
        "sorted", F.when(some, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    ).drop("windows")
    # neighbours of equal hash; then every word from a start to the next start or the window's end
    twice = F.filter(
        F.transform(
            "sorted",
            lambda s, k: F.when(
                (s["h"] == F.get("sorted", k - 1)["h"]) | (s["h"] == F.get("sorted", k + 1)["h"]), s["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    placed = ordered.withColumn("starts", F.sort_array(twice)).drop("sorted")
    gaps = F.transform("starts", lambda a, k: F.coalesce(F.least(F.get("starts", k + 1) - a, F.lit(WINDOW)), F.lit(WINDOW)))
    repeated = F.coalesce(F.aggregate(gaps, F.lit(0), lambda total, x: total + x), F.lit(0))
    whole = placed.withColumn("n_repeat_words", repeated)
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    return whole.select("doc_id", "stratum", *[F.col(n).cast("long").alias(n) for n in names])


def failed_base() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def _rejects(rule: str, cutoff) -> Column:
    measure, factor, unit, _ = RULES[rule]
    return factor * F.col(measure) > cutoff * F.col(unit)


def most_rejections(n: Column, rate: float, level: Column) -> Column:
    """Largest k with P(Binomial(n, rate) <= k) <= level, -1 if there is none.

    The rate of a rule with at most that many rejections among ``n`` is below
    ``rate`` at confidence 1 - level. Probabilities are summed from 0 upwards;
    those too small for a double are far below any level.
    """
    import math

    step = math.log(rate) - math.log1p(-rate)
    zero = F.struct((n * math.log1p(-rate)).alias("log_p"), F.lit(0.0).alias("cdf"), F.lit(-1).alias("best"))

    def more(acc, k):
        cdf = acc["cdf"] + F.exp(acc["log_p"])
        following = acc["log_p"] + F.log((n - k) / (k + 1.0)) + step
        return F.struct(
            F.coalesce(following, F.lit(float("-inf"))).alias("log_p"), cdf.alias("cdf"),
            F.when(cdf <= level, k).otherwise(acc["best"]).alias("best"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.ceil(n * rate).cast("int")), zero, more, lambda acc: acc["best"])


def certified_cutoffs(measured: DataFrame, labels: DataFrame, risk: float, confidence: float) -> DataFrame:
    """(stratum, n_good, one cutoff per rule or null) for the strata that have good labelled documents."""
    good = (
        labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    )
    held = measured.where(~failed_base()).join(good, "doc_id", "left_semi")
    tests = [(rule, c) for rule, (*_, candidates) in RULES.items() for c in candidates]
    counts = held.groupBy("stratum").agg(
        F.count("*").alias("n_good"), *[F.count_if(_rejects(rule, F.lit(c))).alias(f"{rule}_{c}") for rule, c in tests]
    )
    counts = pinned(counts, "cutoffs")
    strata = counts.count()
    if strata > MAX_STRATA:
        raise ValueError(f"{strata} strata; at most {MAX_STRATA} are meant")
    level = F.lit(confidence / max(1, strata * len(tests)))
    allowed = counts.withColumn("allowed", most_rejections(F.col("n_good"), risk / len(RULES), level))
    strictest = [
        F.coalesce(*[F.when(F.col(f"{rule}_{c}") <= F.col("allowed"), F.lit(c)) for c in candidates]).alias(f"{rule}_cutoff")
        for rule, (*_, candidates) in RULES.items()
    ]
    return allowed.select("stratum", "n_good", *strictest)


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, confidence: float = 0.05) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) per row of ``docs``.

    ``docs(doc_id, text, <stratum>)``, ``labels(doc_id, quality)`` with 1 for good.
    ``kept`` is false if the base rule fails or any rule passes the certified
    cutoff of the row's stratum.

    Defined cases: a null or empty text has no words and fails; a null stratum is
    a stratum of its own; texts of any length are measured whole; repeated labels
    of a document count once, as good only if all are; labels without a document
    and null labels are passed over; a stratum without certified cutoffs, or an
    empty label table, rejects by the base rule alone; rows that repeat a doc_id
    are judged one by one; a null doc_id has no label; other columns are ignored;
    an empty table gives an empty table.
    """
    measured = pinned(measures(docs, stratum), "measures")
    cutoffs = certified_cutoffs(measured, labels, risk, confidence).drop("n_good")
    placed = measured.join(F.broadcast(cutoffs), "stratum", "left")  # at most MAX_STRATA rows
    rejected = F.lit(False)
    for rule in RULES:
        rejected = rejected | F.coalesce(_rejects(rule, F.col(f"{rule}_cutoff")), F.lit(False))
    failed = failed_base()
    return placed.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~rejected).alias("kept"),
    )


def _sql() -> str:
    """The same rows in DuckDB SQL, for ``stratum="lang"`` and the default risk and confidence."""
    risk, confidence = 0.02, 0.05
    rate = risk / len(RULES)
    tests = [(rule, c) for rule, (*_, candidates) in RULES.items() for c in candidates]

    def rejects(rule, cutoff, alias="m"):
        measure, factor, unit, _ = RULES[rule]
        return f"{factor} * {alias}.{measure} > {cutoff} * {alias}.{unit}"

    counts = ", ".join(f"count(*) FILTER (WHERE {rejects(r, c)}) AS {r}_{c}" for r, c in tests)
    cutoffs = ", ".join(
        f"CASE {' '.join(f'WHEN {r}_{c} <= allowed THEN {c}' for c in cs)} END AS {r}_cutoff" for r, (*_, cs) in RULES.items()
    )
    verdict = " OR ".join(f"coalesce({rejects(r, f't.{r}_cutoff')}, false)" for r in RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, stratum, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
s AS (SELECT rid, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
r AS (SELECT rid, i FROM s QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
g AS (SELECT rid, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, {WINDOW})) AS n FROM r),
p AS (SELECT rid, sum(n) AS n FROM g GROUP BY rid),
m AS (SELECT w.rid, doc_id, stratum, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS n_symbols, len(ls) AS n_lines,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN p ON p.rid = w.rid),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM m),
l AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
c AS (SELECT stratum, count(*) AS n, {counts} FROM b AS m WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM l) GROUP BY stratum),
k AS (SELECT stratum, n, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({rate}) + (n - k) * ln(1 - {rate})))
        OVER (PARTITION BY stratum ORDER BY k) AS cdf FROM (SELECT stratum, n, unnest(range(0, CAST(ceil(n * {rate}) AS BIGINT) + 1)) AS k FROM c)),
a AS (SELECT stratum, max(k) AS allowed FROM k WHERE cdf <= {confidence} / ((SELECT count(*) FROM c) * {len(tests)}) GROUP BY stratum),
t AS (SELECT c.stratum, {cutoffs} FROM (SELECT c.*, coalesce(a.allowed, -1) AS allowed FROM c LEFT JOIN a ON a.stratum = c.stratum) AS c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({verdict}) AS kept
FROM b AS m LEFT JOIN t ON t.stratum = m.stratum
"""


SQL = _sql()
