"""One-permutation MinHash fingerprints of whole texts (DataFrame functions only).

Shingles of five words are hashed once. The hash's top bits choose one of ``bins`` bins, the
least of the remaining bits in a bin is kept, and a bin without a shingle takes the value of a
bin with one, chosen by a fixed random order of its own (optimal densification). The low
``BITS`` bits of each value are packed as hexadecimal digits. The likeness of two
fingerprints is the share of equal cells, corrected for cells that agree by chance.

Fewer than five words are one shingle. A text without words (null, empty, blanks only) has a
fingerprint of dashes, like itself and unlike any other. Equal texts have equal fingerprints;
so have texts of the same words.

``with_neighbours`` compares each row with the next in key order without one task that sees
all rows: quantiles of the key cut the table into ranges, each range is ordered by itself, and
the row that opens a range is also sent to the range before it. Null keys come first; rows of
equal keys come in order of a hash of their text, and each is a row of its own. The text is
shuffled once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, whole_text, words

SHINGLE = 5
BINS = 128
BITS = 8
#: Rows of a range that ``next_texts`` aims at, and the most ranges.
RANGE_ROWS = 512
MOST_RANGES = 20_000

_HEX = BITS // 4


def _orders(bins: int) -> Column:
    """For each bin a fixed random order of all bins, one after the other in a literal array."""
    r = np.random.default_rng(20_240_601)
    return F.split(F.lit(",".join(str(x) for _ in range(bins) for x in r.permutation(bins))), ",").cast("array<int>")


def shingle_hashes(tokens: Column, size: int = SHINGLE) -> Column:
    """XXH64 of the words of each window of ``size``; of all words, if they are fewer."""
    full = F.transform(
        F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - size + 1, F.lit(0))),
        lambda w, i: F.xxhash64(w, *(F.get(tokens, i + k) for k in range(1, size))),
    )
    return (
        F.when(F.size(tokens) >= size, full)
        .when(F.size(tokens) > 0, F.array(F.xxhash64(F.array_join(tokens, " "))))
        .otherwise(F.array().cast("array<bigint>"))
    )


def fingerprint(text: Column, bins: int = BINS) -> Column:
    """The packed fingerprint of a text: ``bins`` cells of BITS bits in hexadecimal digits."""
    shift = 64 - (bins - 1).bit_length()
    bin_of = lambda h: F.shiftrightunsigned(h, shift).cast("int")
    orders = _orders(bins)

    def least(h: Column) -> Column:
        # In ascending order the first hash of a bin is its least (bins of negative hashes come first).
        first = F.filter(h, lambda x, i: F.coalesce(bin_of(x) != bin_of(F.get(h, i - 1)), F.lit(True)))
        return let(first, cells)

    def cells(first: Column) -> Column:
        found = F.map_from_arrays(F.transform(first, bin_of), F.transform(first, lambda x: x.bitwiseAND((1 << BITS) - 1).cast("int")))
        own = let(found, lambda m: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.try_element_at(m, b)))
        return let(own, lambda v: F.when(F.size(first) == bins, v).otherwise(F.transform(v, lambda x, b: F.coalesce(x, donor(v, b)))))

    def donor(v: Column, b: Column) -> Column:
        quick = [F.get(v, F.get(orders, b * bins + k)) for k in range(6)]
        order = F.slice(orders, b * bins + 1, F.lit(bins))
        return F.coalesce(*quick, F.get(v, F.element_at(F.filter(order, lambda p: F.get(v, p).isNotNull()), 1)))

    def packed(h: Column) -> Column:
        values = F.transform(let(F.sort_array(h), least), lambda x: F.lpad(F.lower(F.hex(x)), _HEX, "0"))
        return F.when(F.size(h) == 0, F.lit("-" * (bins * _HEX))).otherwise(F.array_join(values, ""))

    return let(words(text), lambda w: let(shingle_hashes(w), packed))


def likeness(a: Column, b: Column, bins: int = BINS) -> Column:
    """Estimated share of shingles in common, 0 to 1, with the correction for BITS-bit cells."""
    same = F.aggregate(
        F.sequence(F.lit(0), F.lit(bins - 1)),
        F.lit(0),
        lambda n, i: n + F.when(F.substring(a, i * _HEX + 1, F.lit(_HEX)) == F.substring(b, i * _HEX + 1, F.lit(_HEX)), 1).otherwise(0),
    )
    chance = 2.0**-BITS
    empty = lambda x: F.startswith(x, F.lit("-"))
    return (
        F.when(a == b, F.lit(1.0))
        .when(empty(a) | empty(b), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), (same / F.lit(float(bins)) - chance) / (1 - chance)))
    )


def next_texts(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, part, ghost): rows in ranges of the key; a ghost is another range's first row.

    The first row of all is a ghost at the end of the last range.
    """
    rows = documents.select(F.col(key).cast("long").alias("key"), whole_text(F.col(text)).alias("text"))
    n = rows.count()
    many = min(MOST_RANGES, -(-n // RANGE_ROWS))
    cuts: list[int] = []
    if many > 1:
        marks = [k / many for k in range(1, many)]
        cuts = sorted(set(rows.select("key").agg(F.percentile_approx("key", marks, 100 * many).alias("q")).first()["q"] or []))
    low = rows.agg(F.min("key").alias("low"), F.count_if(F.col("key").isNull()).alias("none")).first()
    splits = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>") if cuts else F.array().cast("array<bigint>")
    # The range is the number of cuts up to the key; a literal array is searched by bisection.
    steps = max(1, len(cuts)).bit_length()
    bisect = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")),
        lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(
            let(
                F.floor((s["lo"] + s["hi"]) / 2).cast("int"),
                lambda m: F.when(F.get(splits, m) <= F.col("key"), F.struct((m + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(
                    F.struct(s["lo"].alias("lo"), m.alias("hi"))
                ),
            )
        ),
        lambda s: s["lo"],
    )
    part = F.when(F.col("key").isNull(), 0).otherwise(bisect)
    rows = rows.withColumn("part", part)
    opens = F.get(splits, F.col("part") - 1) == F.col("key")
    first = F.col("key").isNull() if low and low["none"] else F.col("key") == F.lit(low["low"] if low else None)
    places = F.filter(
        F.array(
            F.struct(F.col("part").alias("part"), F.lit(False).alias("ghost")),
            F.when(F.coalesce(opens, F.lit(False)), F.struct((F.col("part") - 1).alias("part"), F.lit(True).alias("ghost"))),
            F.when(F.coalesce(first, F.lit(False)), F.struct(F.lit(len(cuts)).alias("part"), F.lit(True).alias("ghost"))),
        ),
        lambda x: x.isNotNull(),
    )
    return rows.select("key", "text", F.explode(places).alias("place")).select("key", "text", "place.part", "place.ghost")


def with_neighbours(documents: DataFrame, key: str = "doc_id", text: str = "text", bins: int = BINS) -> DataFrame:
    """Per row: key, n_chars, the edited text's digest, both fingerprints, and the two likenesses.

    The edited text has its last quarter (rounded down) of code points replaced by the first as
    many, or all, of the next row's text; after the last row comes the first.
    """
    along = Window.partitionBy("part").orderBy("ghost", "key", "tie")
    rows = next_texts(documents, key, text).withColumn("tie", F.xxhash64("text"))
    rows = rows.withColumn("after", F.substring(F.lead("text").over(along), F.lit(1), F.floor(F.length("text") / 4).cast("int")))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    made = rows.withColumn("n_chars", F.length("text").cast("long"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - quarter).cast("int")), F.coalesce(F.col("after"), F.lit("")))
    made = made.withColumn("edited", F.when(F.col("ghost"), F.lit("")).otherwise(edited))
    prints = made.select(
        "key", "part", "ghost", "tie", "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("text"), bins).alias("fingerprint"),
        fingerprint(F.col("edited"), bins).alias("edited_fingerprint"),
    )
    prints = prints.withColumn("next_fingerprint", F.lead("fingerprint").over(along)).where(~F.col("ghost"))
    return prints.select(
        F.col("key").alias(key),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), bins).alias("near_edited"),
        likeness(F.col("fingerprint"), F.coalesce("next_fingerprint", "fingerprint"), bins).alias("near_next"),
    )
