"""Quality rules as a ledger of failure bits (DataFrame functions only).

``ledger`` evaluates every rule once per document and gives the measurements and a bit mask
of the rules that failed; ``store`` writes it as a table, and beside it the ablations of all
policies. ``apply_policy`` turns a stored mask into a verdict by a versioned set of rules, and
``ablation`` counts, for each rule of a policy, what it alone rejects: documents are counted by
mask first, then masks are taken apart by their bits, without another look at the text.

Words are runs of ``[^\\x20\\x09-\\x0D]``. A null or empty text has no words and fails
``few_words``. Three-word windows are told apart by 64-bit hashes of their words, compared
only within one text. Everything is computed in the row's own task: no shuffle, and the cost
is that of sorting a text's windows. Rows stay as they are, so repeated rows stay too;
columns of the input besides key and text are dropped by ``ledger``.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, WORD, let, whole_text, words

SYMBOLS = "#*$%&|<>"

#: The rules by bit. Fixed by the base contract: the first two.
FEW_WORDS, REPEATED_WORDS, MANY_SYMBOLS, DUPLICATE_LINES, SHORT_WORDS, LONG_WORDS, SHOUTING = range(7)
RULE_NAMES = ("few_words", "repeated_words", "many_symbols", "duplicate_lines", "short_words", "long_words", "shouting")

#: Policies by version: the rules whose failure rejects a document.
POLICIES: Mapping[str, tuple[int, ...]] = {
    "base": (FEW_WORDS, REPEATED_WORDS),
    "v1": (FEW_WORDS, REPEATED_WORDS, MANY_SYMBOLS, DUPLICATE_LINES, SHORT_WORDS, LONG_WORDS),
    "v2": (FEW_WORDS, REPEATED_WORDS, MANY_SYMBOLS, DUPLICATE_LINES, SHORT_WORDS, LONG_WORDS, SHOUTING),
}


def _chars(text: Column, kept_out: str) -> Column:
    """The number of code points besides those of ``kept_out``."""
    return F.length(F.translate(text, kept_out, "")).cast("long")


def repeated_words(tokens: Column) -> Column:
    """Words that lie in a three-word window which is in the text twice or more.

    Windows are sorted by hash and place; those with an equal neighbour repeat. Their places
    p cover min(3, next p - p) words each, and the last covers three.
    """
    windows = F.transform(
        F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(tokens, i + 1), F.get(tokens, i + 2)).alias("h"), i.alias("i")),
    )

    def places(s: Column) -> Column:
        equal = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, k: equal(x, k - 1) | equal(x, k + 1)), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(F.sort_array(windows), lambda s: let(places(s), covered))


def measures(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, n_upper."""
    t = whole_text(F.col(text))
    d = documents.select(F.col(key), t.alias("_t"), words(F.col(text)).alias("_w"))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD))
    return d.select(
        key,
        F.size("_w").cast("long").alias("n_words"),
        _chars(F.col("_t"), BLANKS).alias("word_chars"),
        (F.length("_t") - _chars(F.col("_t"), SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(lines, lambda x: F.size(x)).cast("long").alias("n_lines"),
        repeated_words(F.col("_w")).alias("n_repeat_words"),
        (F.length("_t") - F.length(F.regexp_replace("_t", "\\p{Lu}", ""))).cast("long").alias("n_upper"),
    )


def failures() -> list[Column]:
    """For each rule, whether a row of ``measures`` fails it; integers only."""
    n = F.col("n_words")
    return [
        n < 50,
        F.col("n_repeat_words") * 100 > n * 50,
        F.col("n_symbols") * 10 > n * 3,
        F.col("n_dup_lines") * 10 > F.col("n_lines") * 3,
        F.col("word_chars") < n * 2,
        F.col("word_chars") > n * 20,
        F.col("n_upper") * 10 > F.col("word_chars") * 4,
    ]


def ledger(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``measures`` and ``failed``: bit k is 1 if rule k of RULE_NAMES fails."""
    bits = [F.when(x, F.lit(1 << k)).otherwise(F.lit(0)) for k, x in enumerate(failures())]
    return measures(documents, key, text).withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long"))


def policy_mask(version: str) -> int:
    return sum(1 << k for k in POLICIES[version])


def apply_policy(rows: DataFrame, version: str, into: str = "kept") -> DataFrame:
    """Adds whether a document passes every rule of the policy."""
    return rows.withColumn(into, F.col("failed").bitwiseAND(policy_mask(version)) == 0)


def ablation(rows: DataFrame, version: str) -> DataFrame:
    """One row per rule of the policy: documents that fail it, and those that only it rejects.

    On an empty ledger all counts are 0.
    """
    mask = policy_mask(version)
    # At most as many masks as the policy's rules have subsets, however many documents there are.
    masks = rows.groupBy(F.col("failed").bitwiseAND(mask).alias("own")).agg(F.count("*").alias("n"))
    sum_where = lambda x: F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0)).cast("long")
    counts = masks.agg(
        sum_where(F.lit(True)).alias("n_documents"),
        *(sum_where(F.getbit("own", F.lit(k)) == 1).alias(f"f{k}") for k in POLICIES[version]),
        *(sum_where(F.col("own").bitwiseXOR(1 << k) == 0).alias(f"o{k}") for k in POLICIES[version]),
    )
    rules = F.array(
        *(F.struct(F.lit(RULE_NAMES[k]).alias("rule"), F.col(f"f{k}").alias("n_failed"), F.col(f"o{k}").alias("n_only")) for k in POLICIES[version])
    )
    return counts.select(F.lit(version).alias("policy"), "n_documents", F.explode(rules).alias("r")).select("policy", "n_documents", "r.*")


def store(documents: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the tables ``ledger`` and ``ablations`` to the folder; the stored ledger."""
    spark, own = documents.sparkSession, ledger(documents, key, text)
    own.write.parquet(f"{folder}/ledger")
    rows = spark.read.schema(own.schema).parquet(f"{folder}/ledger")
    reduce(DataFrame.unionByName, (ablation(rows, version) for version in POLICIES)).write.parquet(f"{folder}/ablations")
    return rows
