"""Substring joins without comparing every pair, at once or by a stored index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriweave.functions.groups import counted_side
from veriweave.session import staged
from veriweave.sources.metadata import union_all
from veriweave.sources.stores import VersionedTable

GRAM = 3
# Terms of up to so many characters join as a whole; so many terms travel to every task.
LONGEST = 16
TERMS_SENT = 250_000


def _grams(c: Column, n: int) -> Column:
    starts = F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - n + 1))
    return F.coalesce(F.transform(starts, lambda i: F.substring(c, i, F.lit(n))), F.array().cast("array<string>"))


def _term_grams(terms: DataFrame) -> DataFrame:
    """The runs of ``GRAM`` characters of each term; a shorter term is its own."""
    own = F.when(F.length("term") >= GRAM, _grams(F.col("term"), GRAM)).otherwise(F.array(F.col("term")))
    return terms.filter("term <> ''").select("term", F.explode(F.array_distinct(own)).alias("gram"))


def _runs() -> Column:
    """All runs of up to ``GRAM`` characters of a text, each once."""
    return F.array_distinct(F.concat(*[_grams(F.col("text"), n) for n in range(1, GRAM + 1)]))


def containing(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """All pairs (term, text) where the text contains the term; both compare as they are.

    ``terms`` has a column ``term``, distinct; ``texts`` a column ``text`` and any others, which
    stay. A text contains a term when one of its runs of characters is the term, so the two join
    on whole runs, of the lengths that terms have, and a join makes no pair that is not asked for.
    Terms above ``LONGEST`` characters join on the one run of that length of their own that the
    fewest texts have.
    """
    known = terms.filter("term <> ''").select("term", F.least(F.length("term"), F.lit(LONGEST)).alias("n"), (F.length("term") > LONGEST).alias("long"))
    lengths = sorted((r["n"], r["long"]) for r in known.select("n", "long").distinct().collect())
    short = [n for n, long in lengths if not long]
    found = [texts.select(F.lit(None).cast("string").alias("term"), "*").limit(0)] if not lengths else []
    if short:
        asked = counted_side(known.filter(~F.col("long")).select("term"), TERMS_SENT)
        found.append(_exploded(texts, short, "term").join(asked, "term").select("term", *texts.columns))
    if len(lengths) > len(short):
        found.append(_containing_long(known.filter("long").select("term"), texts))
    return union_all(found)


def _exploded(texts: DataFrame, lengths: list[int], out: str) -> DataFrame:
    """Texts with each of their runs of these lengths, each once."""
    runs = F.array_distinct(F.concat(*[_grams(F.col("text"), n) for n in lengths]))
    return texts.select("*", F.explode(runs).alias(out))


def _containing_long(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """``containing`` for terms above ``LONGEST`` characters. Counting and joining read one shuffle of the runs."""
    term_runs = terms.select("term", F.explode(F.array_distinct(_grams(F.col("term"), LONGEST))).alias("run"))
    wanted = counted_side(term_runs.select("run").distinct())
    index = _exploded(texts, [LONGEST], "run").join(wanted, "run", "left_semi").repartition("run")
    frequency = index.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    rarest = term_runs.join(frequency, "run", "left").groupBy("term").agg(
        F.min_by("run", F.struct(F.coalesce("n", F.lit(0)), F.col("run"))).alias("run")
    )
    return counted_side(rarest, like=terms).join(index, "run").filter(F.col("text").contains(F.col("term"))).select("term", *texts.columns)


# A run that many texts have is kept in so many places, so that no bucket holds all of it.
PLACES = 16


@dataclass(frozen=True)
class GramIndex:
    """A stored index of the runs of characters of texts: which texts have a run, and how many (GQ10-GQ13)."""

    postings: VersionedTable
    frequency: VersionedTable

    @staticmethod
    def at(spark: SparkSession, path: str, buckets: int = 64) -> GramIndex:
        """The index in a folder, which may still be empty."""
        return GramIndex(
            VersionedTable(spark, f"{path}/postings", key="posting", buckets=buckets, bucket_by="place"),
            VersionedTable(spark, f"{path}/frequency", key="gram", buckets=buckets),
        )

    def build(self, texts: DataFrame) -> None:
        """Index all texts (distinct, column ``text``) anew."""
        self.postings.replace(_postings(texts))
        self.frequency.replace(self.postings.read().groupBy("gram").agg(F.count(F.lit(1)).alias("n")))

    def update(self, added: DataFrame, removed: DataFrame) -> tuple[int, int]:
        """Index texts that came and forget texts that went; how many buckets were written.

        A text that is known is not added again and one that is not known is not removed, so an
        update that is repeated changes nothing. Only buckets of runs of those texts are read
        and written.
        """
        came = staged(self._known(added, "left_anti"), "added")
        gone = staged(self._known(removed, "left_semi"), "removed")
        more, less = _postings(came), _postings(gone)
        written = self.postings.change(more, less.select("posting", "place"))
        change = more.select("gram", F.lit(1).alias("d")).unionByName(less.select("gram", F.lit(-1).alias("d"))).groupBy("gram").agg(F.sum("d").alias("d"))
        change = staged(change.filter("d <> 0"), "frequency")
        now = change.join(self.frequency.lookup(change), "gram", "left").select("gram", (F.coalesce("n", F.lit(0)) + F.col("d")).alias("n"))
        # Frequencies only choose the run that is read, so what was not reached by a crash costs time, not results.
        now = staged(now, "frequency")
        return written, self.frequency.change(now.filter("n > 0"), now.filter("n <= 0").select("gram"))

    def _known(self, texts: DataFrame, how: str) -> DataFrame:
        """Texts by whether the posting of their first character is there."""
        distinct = texts.select("text").filter("text <> ''").distinct()
        first = _posted(distinct.withColumn("gram", F.substring("text", 1, 1)))
        stored = self.postings.lookup(first.select("place")).select("posting")
        return first.join(stored, "posting", how).select("text")

    def search(self, terms: DataFrame) -> DataFrame:
        """All pairs (term, text) where the text contains the term, as ``containing`` gives them, by the rarest run of each term."""
        grams = _term_grams(terms)
        counts = self.frequency.lookup(grams.select("gram"))
        rarest = grams.join(counts, "gram", "left").groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("gram"))
        asked = staged(rarest, "rarest")
        places = asked.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(PLACES - 1)), lambda i: F.concat_ws("\x1f", "gram", i))).alias("place"))
        return asked.join(self.postings.lookup(places).select("gram", "text"), "gram").filter(F.col("text").contains(F.col("term"))).select("term", "text")


def _posted(rows: DataFrame) -> DataFrame:
    """Rows (text, gram) with the key of each posting and the place of its run."""
    return rows.withColumn("posting", F.concat_ws("\x1f", "gram", "text")).withColumn("place", F.concat_ws("\x1f", "gram", F.pmod(F.xxhash64("text"), F.lit(PLACES))))


def _postings(texts: DataFrame) -> DataFrame:
    return _posted(texts.select("text", F.explode(_runs()).alias("gram")))
