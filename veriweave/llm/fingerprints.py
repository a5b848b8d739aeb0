"""Document fingerprints by Order MinHash (3), with DataFrame functions only.

The k-mers of a text are its runs of ``k`` words; the n-th use of a k-mer counts as an
element of its own. Every tuple has a hash function of its own and takes its two least
elements over the whole text; they stay in the order in which they stand in the text and
are hashed together, so that a signature changes when passages are swapped, not only when
they are replaced.

Defined results: a null or empty text has the signature of empty tuples; a text with
fewer than ``k`` words is one k-mer; a tuple of a text with one k-mer holds that alone; documents are ordered by id, a null id first, and
by text where ids repeat, and the last is followed by the first; repeated rows give one
row each; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriweave.llm.common import id_and_text

K = 3
TUPLES = 32
# Place of a k-mer in its text: so many low bits of a packed element; the rest is its hash.
PLACE_BITS = 25
# Rows of a range of ids that are sorted together.
RANGE_ROWS = 4000
MAX_RANGES = 100_000
# White space between words.
_WHITE = " \t\n\x0b\f\r"
_LEAST_LONG, _GREATEST_LONG = -(1 << 63), (1 << 63) - 1
# Elements of a text that a tuple looks at for its two least, about; where none or one of them is among those it looks at all.
FEW = 8


def _high(x: Column) -> Column:
    return F.shiftright(x, PLACE_BITS)


def with_signature(df: DataFrame, text: str, out: str, k: int = K, tuples: int = TUPLES) -> DataFrame:
    """Add ``out``: one hash per tuple (null where the text has no word), as an array of bigint.

    Each step is a column of its own that the next uses more than once, or given to a lambda;
    Spark would put it back into the lambda and compute it for every element otherwise.
    """
    if tuples < 1:
        raise ValueError("tuples must be positive")
    kept = df.columns
    place_mask = (1 << PLACE_BITS) - 1
    no_place = F.lit(~place_mask)
    words, n, grams, starts, in_text = (f"_{out}_{x}" for x in ("words", "n", "grams", "starts", "elements"))
    step = df.withColumn(words, F.split(F.btrim(F.col(text), F.lit(_WHITE)), "[ \\t\\n\\x0B\\f\\r]+"))
    step = step.withColumn(n, F.when(F.element_at(words, 1) == "", 0).otherwise(F.size(words)))
    # Sorted by k-mer, then place.
    gram = lambda i: F.xxhash64(*[F.get(F.col(words), i + j) for j in range(k)])
    step = step.withColumn(
        grams,
        F.when(F.col(n) == 0, F.array().cast("array<bigint>")).otherwise(
            F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(F.col(n) - k, F.lit(0))), lambda i: gram(i).bitwiseAND(no_place).bitwiseOR(i.cast("long"))))
        ),
    )
    # Where the uses of each k-mer begin in that order; the occurrence number follows from it.
    step = step.withColumn(
        starts,
        F.filter(
            F.transform(F.col(grams), lambda x, i: F.when((i == 0) | (_high(x) != _high(F.get(F.col(grams), i - 1))), i).otherwise(F.lit(-1))),
            lambda i: i >= 0,
        ),
    )
    # Place above, hash below: sorted, the elements stand as in the text.
    element = lambda x, use: F.shiftleft(x.bitwiseAND(F.lit(place_mask)), 63 - PLACE_BITS).bitwiseOR(F.shiftrightunsigned(F.xxhash64(_high(x), use), PLACE_BITS + 1))
    uses = F.flatten(
        F.transform(F.col(starts), lambda s, m: F.sequence(F.lit(0), F.coalesce(F.get(F.col(starts), m + 1), F.size(grams)) - s - 1))
    )
    elements = F.when(F.size(starts) == F.size(grams), F.transform(F.col(grams), lambda x: element(x, F.lit(0)))).otherwise(
        F.zip_with(F.col(grams), uses, element)
    )
    step = step.withColumn(in_text, F.sort_array(elements))
    hash_mask = F.lit((1 << (63 - PLACE_BITS)) - 1)
    step = step.withColumn(in_text, F.transform(F.col(in_text), lambda x: x.bitwiseAND(hash_mask)))
    # A value computed once and used several times inside a lambda.
    given = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))

    def in_order(hashes: Column, a: Column, b: Column) -> Column:
        ahead = b.isNull() | (F.array_position(hashes, a) < F.array_position(hashes, b))
        return F.when(a.isNotNull(), F.when(ahead, F.xxhash64(a, b)).otherwise(F.xxhash64(b, a)))

    def tuple_hash(t: Column, most: Column) -> Column:
        least_two = lambda hashes: given(F.array_min(hashes), lambda a: given(F.array_min(F.array_remove(hashes, a)), lambda b: in_order(hashes, a, b)))
        small = F.filter(F.col(in_text), lambda x: F.xxhash64(x, t) <= most)
        # Two that are small hold the two least; without them all elements are taken.
        of = lambda own: given(F.transform(F.when(F.size(own) > 1, own).otherwise(F.col(in_text)), lambda x: F.xxhash64(x, t)), least_two)
        return given(small, of)

    # About ``FEW`` of a tuple's hashes are at or below this.
    size = F.size(in_text)
    small = F.when(size <= 2 * FEW, F.lit(_GREATEST_LONG)).otherwise(F.lit(_LEAST_LONG) + F.floor(F.lit(1 << 50) / size) * F.lit(FEW << 14))
    every = lambda most: F.transform(F.sequence(F.lit(0), F.lit(tuples - 1)), lambda t: tuple_hash(t, most))
    return step.withColumn(out, given(small, every)).select(*kept, out)


def as_text(signature: Column) -> Column:
    """A signature as a string: 16 hex digits per tuple, dashes where it is empty."""
    return F.array_join(F.transform(signature, lambda h: F.coalesce(F.lower(F.lpad(F.hex(h), 16, "0")), F.lit("-" * 16))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples among those that are not empty in both; 1 for two empty signatures."""
    pairs = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), F.lit(-1)).otherwise(F.coalesce((x == y).cast("int"), F.lit(0))))
    equal, some = F.size(F.filter(pairs, lambda x: x == 1)), F.size(F.filter(pairs, lambda x: x >= 0))
    return F.when(some == 0, F.lit(1.0)).otherwise(equal / some)


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at or below the key, by two short searches."""
    if not bounds:
        return F.lit(0)
    width = isqrt(len(bounds)) + 1
    below = lambda values: F.size(F.filter(values, lambda b: b <= key))
    coarse = below(F.lit(bounds[width - 1 :: width]))
    return coarse * width + below(F.slice(F.lit(bounds), coarse * width + 1, F.lit(width)))


def with_next(docs: DataFrame, columns: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``next_<column>``: values of the following document, by id; the last is followed by the first.

    Ids are cut into ranges at quantiles; texts are shuffled once, by range. The first
    document of a range is also sent to the range before it, where it closes the row.
    """
    keyed = docs.withColumn("_key", F.coalesce(F.col("doc_id"), F.lit(_LEAST_LONG)))
    ids = keyed.select("_key")
    n_ranges = max(1, min(MAX_RANGES, ids.count() // range_rows))
    bounds: list[int] = []
    if n_ranges > 1:
        cuts = F.percentile_approx("_key", [i / n_ranges for i in range(1, n_ranges)], 20 * n_ranges)
        bounds = sorted(set(ids.agg(cuts.alias("cuts")).first()["cuts"]))
    ranged = keyed.withColumn("_range", _range_of(F.col("_key"), bounds))
    least = dict(ids.withColumn("_range", _range_of(F.col("_key"), bounds)).groupBy("_range").agg(F.min("_key")).collect())
    if not least:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    used = sorted(least)
    before = dict(zip(used, [used[-1], *used[:-1]], strict=True))
    size = used[-1] + 1
    least_of = F.get(F.lit([least.get(i, 0) for i in range(size)]), F.col("_range"))
    before_of = F.get(F.lit([before.get(i, 0) for i in range(size)]), F.col("_range"))
    own = F.struct(F.col("_range").alias("to"), F.lit(False).alias("closing"))
    ahead = F.struct(before_of.alias("to"), F.lit(True).alias("closing"))
    copies = F.when(F.col("_key") == least_of, F.array(own, ahead)).otherwise(F.array(own))
    order = Window.partitionBy("_place.to").orderBy("_place.closing", "_key", "text")
    return (
        ranged.withColumn("_place", F.explode(copies))
        .select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
        .filter(~F.col("_place.closing"))
        .drop("_key", "_range", "_place")
    )


def fingerprints(docs: DataFrame, k: int = K, tuples: int = TUPLES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Signatures of every whole text and of its edited text, with their likeness.

    The edited text has its last floor(n / 2) characters replaced by the first as many of
    the next document.
    """
    signed = with_signature(id_and_text(docs), "text", "signature", k, tuples)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = (
        with_next(signed, ["text", "signature"], range_rows)
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half)))
        .drop("next_text")
    )
    return with_signature(edited, "edited", "edited_signature", k, tuples)


def compared(docs: DataFrame, **options) -> DataFrame:
    """Fingerprints as strings, the digest of the edited text and the two likenesses."""
    return fingerprints(docs, **options).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("signature")).alias("fingerprint"),
        as_text(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
