"""Mixing sources to target weights, in fixed-length blocks of words.

Documents of a source, in a hashed order, form one run of words that is cut into blocks. The mix is a row of slots, cut
into output shards of `shard_blocks` slots. Every shard draws how many blocks it takes of each source from a multinomial
distribution: each of its slots draws a source by weight. The counts over all shards then miss the sources' totals by
chance; they are repaired: of a source drawn too often, the last slots go, in order, to sources drawn too seldom. So
each source gets as many slots as its target asks for. A source's slots go through a pseudorandom permutation of its
own block indices, again from the start where a source is used more than once, so no block is taken twice before all
were taken once. Blocks are joined by index.

Permutations are computed, not stored: swap-or-not rounds, for any range, from hashes. Reruns agree.
All work is in built-in column functions. For the counts, texts are read once, for their sizes; for the mix itself, a
text travels to its place in its source's run, and its pieces to their blocks.

Scale: a source's run is summed in hashed cells of about `cell_rows` documents, so a source that holds a third of all
documents is spread over many tasks; per-source figures are one row each. Slots are dealt over tasks by their number;
a slot's source is found by an equi-join on pieces of the range of all slots, broadcast only if counted to be few.

Defined results: a null text has size 0; a document of size 0 is never taken. A null source is a source, the last in
order. Repeated rows, and rows with a null doc_id, are documents of their own. A very long text is pieces like any
other. Other input columns are ignored by mix(), and carried, whatever their names, by pieces() and mixed(). An empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import BLANKS, let, words_of, written

ROUNDS = 24
#: Between a blank and a word: a text cut here has its words with the blanks that follow them.
WORD_START = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources(source, source_size) with rank, weight and target; a row for each source.

    Shares of `share` times all words by weight, where a source stops at `most` times its size and what is over goes
    to the others by weight: each gets min(most * size, weight * level) for one level, found from running sums in the
    order in which sources reach their stop.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("rank", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("stop", F.lit(most) * F.col("source_size"))
    before = Window.orderBy(F.col("stop") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    s = s.withColumn("level", left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    enough = F.when(F.col("stop") / F.col("weight") >= F.col("level"), F.col("level"))
    return s.withColumn("target", F.least("stop", F.col("weight") * F.coalesce(F.max(enough).over(everything), F.lit(0.0)))).drop("level", "stop")


def permuted(at: Column, size: Column, seed: Column) -> Column:
    """A pseudorandom permutation of range(size), applied to `at` (swap-or-not rounds)."""

    def shuffle(v: Column) -> Column:
        def one_round(x: Column, k: Column) -> Column:
            other = F.pmod(F.pmod(F.xxhash64(v["seed"], k), v["size"]) - x, v["size"])
            return let(other, lambda o: F.when(F.xxhash64(v["seed"], -1 - k, F.greatest(x, o)) % 2 == 0, o).otherwise(x))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), v["at"], one_round)

    return let(F.struct(at.alias("at"), size.alias("size"), seed.alias("seed")), shuffle)


def mix(docs: DataFrame, seed: int = 0, **settings) -> DataFrame:
    """docs(doc_id, text, source) to doc_id, source, size, source_size, target and taken, a row for each row.

    taken: the words of the document that the drawn blocks hold, repeats counted. settings: as for plan().
    """
    thin = written(_thin(docs), "words")
    made = plan(thin, seed=seed, **settings)
    placed = made.place(thin)
    own = ["rank", "start", "doc_id", "source", "size", "source_size", "target"]
    at = placed.where("size > 0").select(*own, F.explode(made.blocks()).alias("block"))
    times = made.slots.groupBy("rank", "block").agg(F.count("*").alias("times"))
    taken = at.join(times, ["rank", "block"], "left").groupBy(*own).agg(F.sum((made.stop() - made.begin()) * F.coalesce("times", F.lit(0))).alias("taken"))
    empty = placed.where("size = 0").select(*own, F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(empty).drop("rank", "start")


def pieces(docs: DataFrame, seed: int = 0, **settings) -> DataFrame:
    """The mix itself: shard, slot, rank (of the source), block, place (of the piece in its block) and row.

    row holds all columns of a document; its text is what of it stands in the block, with the blanks that follow words.
    """
    thin = written(_thin(docs), "words")
    made = plan(thin, seed=seed, **settings)
    placed = made.place(_thin(docs, F.struct(*(docs[c] for c in docs.columns)))).where("size > 0")
    skipped = lambda v, b: F.greatest(v["start"] - b * made.block_words, F.lit(0)).cast("int")  # noqa: E731  words of the block before this text
    part = lambda v, b: F.array_join(F.slice(v["words"], (F.greatest(b * made.block_words - v["start"], F.lit(0)) + 1).cast("int"), F.lit(made.block_words) - skipped(v, b)), "")
    cut = let(
        F.struct(_split(F.col("row.text")).alias("words"), "start", made.blocks().alias("blocks")),
        lambda v: F.transform(v["blocks"], lambda b: F.struct(b.alias("block"), part(v, b).alias("text"), skipped(v, b).alias("place"))),
    )
    at = placed.select("rank", F.struct(*(F.col("row")[c].alias(c) for c in docs.columns if c != "text")).alias("others"), F.explode_outer(cut).alias("piece"))  # none is empty; the plain form adds a filter that works cut out once more
    at = at.select("rank", "others", "piece.block", "piece.text", "piece.place")
    row = F.struct(*(F.col("text") if c == "text" else F.col("others")[c].alias(c) for c in docs.columns))
    return at.join(made.slots, ["rank", "block"]).select("shard", "slot", "rank", "block", "place", row.alias("row"))


def blocks(docs: DataFrame, seed: int = 0, **settings) -> DataFrame:
    """The mix, a row for each slot: shard, slot, source, block, text (the words of the block, joined by index) and doc_ids."""
    parts = F.sort_array(F.collect_list(F.struct("place", F.col("row.text").alias("text"), F.col("row.doc_id").alias("doc_id"))))  # a block's words at most
    made = pieces(docs, seed=seed, **settings).groupBy("shard", "slot", "block").agg(F.first("row.source").alias("source"), parts.alias("parts"))
    spaced = F.transform("parts", lambda p: F.rtrim(p["text"], F.lit(BLANKS)))
    return made.select("shard", "slot", "source", "block", F.array_join(spaced, "\n").alias("text"), F.col("parts.doc_id").alias("doc_ids"))


def mixed(docs: DataFrame, seed: int = 0, **settings) -> DataFrame:
    """The mix as rows with the columns of docs: a row for each piece of a document in a drawn block."""
    return pieces(docs, seed=seed, **settings).select("row.*")


def _split(text: Column) -> Column:
    """The words of a text that has some, each with the blanks that follow it."""
    return F.split(F.ltrim(text, F.lit(BLANKS)), WORD_START)


def _thin(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """docs to doc_id, source, size and a hash of the text, with row if it is given."""
    kept = [] if row is None else [row.alias("row")]
    return docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("text_hash"), *kept)


@dataclass
class Plan:
    """sources: one row each; parts: words before each cell of a source's run; slots: (slot, shard, rank, block), the mix."""

    block_words: int
    cells: int
    seed: int
    parts: DataFrame
    slots: DataFrame

    def place(self, thin: DataFrame) -> DataFrame:
        """thin with rank, source_size, target and start: the words before it in its source's run."""
        placed = thin.withColumn("cell", cell_of(self.cells, self.seed)).join(self.parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c"))).drop("s", "c")
        within = Window.partitionBy("rank", "cell").orderBy("doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return placed.withColumn("start", F.col("base") + F.sum("size").over(within) - F.col("size"))

    def blocks(self) -> Column:
        """The blocks that a placed document of some words is in."""
        return F.expr(f"sequence(start div {self.block_words}, (start + size - 1) div {self.block_words})")

    def begin(self) -> Column:
        return F.greatest("start", F.col("block") * self.block_words)

    def stop(self) -> Column:
        return F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * self.block_words)


def cell_of(cells: int, seed: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed)), F.lit(cells)).cast("int")


def plan(thin: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block_words: int = 128, shard_blocks: int = 4096, cell_rows: int = 20_000, seed: int = 0) -> Plan:
    """thin(doc_id, source, size, text_hash), stored, to the plan of the mix."""
    cells = max(64, -(-thin.count() // cell_rows))
    parts = written(thin.groupBy("source", cell_of(cells, seed).alias("cell")).agg(F.sum("size").alias("words")), "cells")
    sources = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    sources = sources.withColumn("n_blocks", F.ceil(F.col("source_size") / block_words))
    # slots for which the words expected are the target; a source's last block may be short
    sources = sources.withColumn("n_slots", F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("n_blocks") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long"))
    by_rank = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sources = written(sources.withColumn("slots_to", F.sum("n_slots").over(by_rank)), "sources")

    running = Window.partitionBy("rank").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.join(sources.select(F.col("source").alias("s"), "rank", "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    parts = parts.withColumn("base", F.coalesce(F.sum("words").over(running), F.lit(0)))
    parts = written(parts.select(F.col("source").alias("s"), F.col("cell").alias("c"), "rank", "source_size", "target", "base"), "parts")
    return Plan(block_words, cells, seed, parts, written(draws(sources, shard_blocks, seed), "slots"))


def draws(sources: DataFrame, shard_blocks: int, seed: int) -> DataFrame:
    """sources(rank, n_blocks, n_slots, slots_to), stored, to the mix: slot, shard, rank and block, a row for each slot."""
    own = sources.where("n_slots > 0").select("rank", "n_blocks", "n_slots", (F.col("slots_to") - F.col("n_slots")).alias("slots_from"))
    n, count = own.agg(F.coalesce(F.sum("n_slots"), F.lit(0)), F.count("*")).first()
    slots = sources.sparkSession.range(0, n, 1, max(8, n >> 15)).select(F.col("id").alias("slot"), F.expr(f"id div {shard_blocks}").alias("shard"))
    drawn = found_in(slots.withColumn("at", F.pmod(F.xxhash64(F.lit(seed), "slot"), F.lit(max(n, 1)))), own, "slots_from", "n_slots", n, count)
    drawn = drawn.select("slot", "shard", "rank")

    # every shard's counts, and the number of slots that each source has in the shards before
    counts = written(drawn.groupBy("rank", "shard").agg(F.count("*").alias("c")).withColumn("group", F.expr("shard div 4096")), "counts")
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("rank").agg(F.sum("c").alias("total"))
    groups = counts.groupBy("rank", "group").agg(F.sum("c").alias("c")).select("rank", "group", F.coalesce(F.sum("c").over(before("rank", "group")), F.lit(0)).alias("g"))
    counts = counts.join(groups, ["rank", "group"]).select("rank", "shard", (F.col("g") + F.coalesce(F.sum("c").over(before("rank", "group", "shard")), F.lit(0))).alias("base"))
    # the repair: slots over a source's number, numbered in order, are the places of those that are short
    own = own.join(totals, "rank", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    over, short = F.greatest(F.col("total") - F.col("n_slots"), F.lit(0)), F.greatest(F.col("n_slots") - F.col("total"), F.lit(0))
    by_rank = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    own = written(own.withColumns({"over_from": F.coalesce(F.sum(over).over(by_rank), F.lit(0)), "short": short, "short_from": F.coalesce(F.sum(short).over(by_rank), F.lit(0))}), "repairs")
    moved = own.agg(F.coalesce(F.sum("short"), F.lit(0))).first()[0]

    few = F.broadcast if count <= BROADCAST else lambda df: df
    first = Window.partitionBy("shard", "rank").orderBy("slot")  # a shard's slots at most
    drawn = drawn.withColumn("i", F.row_number().over(first) - 1).join(counts, ["rank", "shard"])
    drawn = drawn.select("slot", "shard", "rank", (F.col("base") + F.col("i")).alias("own")).join(few(own.select("rank", "n_blocks", "n_slots", "over_from")), "rank")
    kept = drawn.where("own < n_slots").select("slot", "shard", "rank", "own", "n_blocks")
    loose = drawn.where("own >= n_slots").select("slot", "shard", (F.col("over_from") + F.col("own") - F.col("n_slots")).alias("at"))
    given = found_in(loose, own.where("short > 0"), "short_from", "short", moved, count)
    given = given.select("slot", "shard", "rank", (F.col("total") + F.col("at") - F.col("short_from")).alias("own"), "n_blocks")
    dealt = kept.unionByName(given).withColumns({"turn": F.col("own") % F.col("n_blocks"), "order": F.xxhash64(F.lit(seed), "rank")})
    return dealt.select("slot", "shard", "rank", permuted(F.col("turn"), F.col("n_blocks"), F.col("order")).alias("block"))


BROADCAST = 100_000  # sources that are broadcast; more are shuffled


def found_in(points: DataFrame, ranges: DataFrame, start: str, length: str, whole: int, count: int) -> DataFrame:
    """points(at) with the columns of the one of `ranges` (start, length) that holds at; they cut [0, whole).

    The whole is cut into a few times as many bins as there are ranges; ranges are listed by bin, so the join is by equality.
    """
    step = max(1, whole // (4 * max(1, count)))
    listed = ranges.withColumn("bin", F.explode(F.expr(f"sequence({start} div {step}, ({start} + {length} - 1) div {step})")))
    listed = F.broadcast(listed) if count <= BROADCAST else listed
    both = points.withColumn("bin", F.expr(f"at div {step}")).join(listed, "bin")
    return both.where((F.col("at") >= F.col(start)) & (F.col("at") < F.col(start) + F.col(length))).drop("bin")
