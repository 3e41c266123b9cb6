"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items become templates: numbers, names (words with a capital) and units turn into typed
placeholders, all other words into lower case. Hashes of template windows are joined, and of windows of the plain
lower-case words too, so that a passage is found whatever its case makes of its names. Windows
of one document and item on one diagonal (the same shift) form an alignment; it counts if it holds enough windows and
its slots are consistent: the same value in the item always meets the same value in the document. So a question is
found again with other numbers and names, while a chance match of a frame with unrelated fillings is not.

Windows are searched in folded templates, too, of items and documents: there a run of names is one placeholder, and a
unit behind a number is part of it. So 'Tom' meets 'Tom Smith', and '5 km' meets '5km', without a break in the diagonal.
A folded slot has the value of its first word. Only items that still have `window` tokens are searched for so.

All work is in built-in column functions. Documents are not shuffled to find windows as long as the benchmark's
windows are few enough to broadcast (counted first; beyond that both sides are shuffled by hash).

Items of `window` tokens or more are searched by windows of that length; shorter ones, down to `least_tokens`, by
windows of that many, of which all must be found. Template windows with fewer than half of their tokens literal tell
nothing and are searched by their plain words only; where too few others are left to count, those must all be found
and the template of the whole item must be there. Items with fewer tokens tell nothing and are not searched;
unsearched() lists them.

Defined results: a null or empty text is never contaminated. A very long text is searched to its end, as one row. Repeated rows get equal results; rows with a null doc_id
too, each by its own text. Null and repeated items are ignored. Other input columns are ignored. An empty table of
documents gives an empty result; with an empty benchmark every document is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import BLANK_RUN, BLANKS, written

# Units of measure, currency and time in lower case, without those that are also common words.
UNITS = (
    "mm cm dm km inch inches ft feet yd yard yards mile miles mg kg lb lbs oz pound pounds ounce ounces ton tons "
    "ml cl dl liter liters litre litres gallon gallons sec second seconds minute minutes hr hour hours day days week weeks "
    "month months year years percent pct degree degrees kw kwh mb gb tb hz khz mhz ghz mph kmh dollar dollars euro euros cent cents usd eur gbp"
).split()
# Marks that are dropped.
MARKS = ".!?,;:\"'()[]{}#*$%&<>|"


def with_tokens(df: DataFrame) -> DataFrame:
    """df(text) with tok and low: words without MARKS, as written and in lower case; a blank text has an empty one."""
    df = df.withColumn("_t", F.btrim(F.translate(F.coalesce("text", F.lit("")), MARKS, ""), F.lit(BLANKS)))
    return df.withColumns({"tok": F.split("_t", BLANK_RUN), "low": F.split(F.lower("_t"), BLANK_RUN)}).withColumn("n_tok", F.size("tok")).drop("_t")


def template(use: Callable[[Column], Column] = lambda x: x) -> Column:
    """use(placeholder or lower-case word) for each word of tok and low.

    A capital marks a name, unless all letters are capitals: shouted words are words.
    """

    def kind(word: Column, low: Column) -> Column:
        return use(F.when(word != low, F.when(word == F.upper(word), low).otherwise("<name>")).when((low >= "0") & (low < ":"), "<num>").when(low.isin(*UNITS), "<unit>").otherwise(low))

    return F.zip_with("tok", "low", kind)


def _continues(x: Column, before: Column, of: Callable[[Column], Column] = lambda x: x) -> Column:
    """Whether a placeholder belongs to the slot of the one before it; of: what was made of both."""
    name, num, unit = (of(F.lit(c)) for c in ("<name>", "<num>", "<unit>"))
    return F.coalesce(((x == name) & (before == name)) | ((x == unit) & (before == num)), F.lit(False))


def places(tpl: str) -> Column:
    """The places (from 0) of a template's words that stay when it is folded."""
    return F.filter(F.sequence(F.lit(0), F.size(tpl) - 1), lambda i: ~_continues(F.get(tpl, i), F.get(tpl, i - 1)))


def folded(c: str) -> Column:
    return F.transform("places", lambda i: F.get(c, i))


def runs(c: str) -> Column:
    """For each of places, the words of c that it stands for.

    Give c no new value in the same step: inside a lambda, its name would mean the new one.
    """
    after = F.concat(F.slice("places", 2, F.size("places")), F.array(F.size(c)))
    return F.zip_with("places", after, lambda i, k: F.array_join(F.slice(c, i + 1, k - i), " "))


def with_windows(df: DataFrame, window: int, fold: bool) -> DataFrame:
    """df(tok, low, n_tok) with n_win and win: hashes of all n_win template windows of `window` (a power of two) tokens, by
    doubling, then those of the windows of low, then, with fold, those of the folded template, if that is another one.

    Explode win with posexplode_outer: the plain form adds a filter that would work all steps out once more.
    """
    df = df.withColumns({"win": template(lambda x: F.xxhash64(x)), "plain": F.transform("low", lambda x: F.xxhash64(x))})
    lengths = {"win": F.col("n_tok"), "plain": F.col("n_tok")}
    if fold:
        df = df.withColumn("fold", F.filter("win", lambda x, i: ~_continues(x, F.get("win", i - 1), F.xxhash64)))
        df = df.withColumn("fold", F.when(F.size("fold") < F.col("n_tok"), F.col("fold")).otherwise(F.array().cast("array<bigint>"))).withColumn("n_fold", F.size("fold"))
        lengths["fold"] = F.col("n_fold")
    width = 1
    while width < window:
        n = {c: F.greatest(size - 2 * width + 1, F.lit(0)) for c, size in lengths.items()}
        df = df.withColumns({c: F.zip_with(F.slice(c, 1, n[c]), F.slice(c, 1 + width, n[c]), lambda a, b: F.xxhash64(a, b)) for c in lengths})
        width *= 2
    return df.withColumns({"n_win": F.greatest(F.col("n_tok") - window + 1, F.lit(0)), "win": F.concat(*lengths)}).drop("plain", "fold", "n_fold")


def _hits(docs: DataFrame, items: DataFrame, window: int, need: int, broadcast_rows: int, fold: bool) -> DataFrame:
    """Alignments (doc_id, text_key, item_id, ifold, dfold, shift, first, last, n_windows, whole) with enough windows.

    ifold, dfold: places are those of the folded item or document. whole: it has all template windows of an item that
    has too few; the template of the whole item must match.
    """
    literal = F.size(F.filter(F.slice(F.col("tpl"), F.col("ipos") + 1, window), lambda x: ~x.isin("<num>", "<name>", "<unit>")))
    wins = with_windows(items, window, False).select("item_id", "ifold", "tpl", "n_win", F.posexplode_outer("win").alias("at", "win")).where("win is not null")
    wins = wins.withColumns({"ipos": F.col("at") % F.col("n_win"), "form": F.col("at") < F.col("n_win")})
    wins = wins.where(F.when(F.col("form"), literal >= window // 2).otherwise(~F.col("ifold"))).groupBy("item_id", "ifold", "n_win", "ipos", "win").agg(F.max("form").alias("form"))
    wins = written(wins.select("item_id", "ifold", F.col("n_win").alias("n_item"), "ipos", "win", "form"), "windows")
    forms = wins.where("form").groupBy("item_id", "ifold").agg(F.count("*").alias("n_form"))
    wins = written(wins.join(forms, ["item_id", "ifold"], "left"), "windows")
    n = wins.count()
    if not n:
        return None
    wins = F.broadcast(wins) if n <= broadcast_rows else wins
    found = with_windows(docs, window, fold).select("doc_id", "text_key", "n_win", F.posexplode_outer("win").alias("pos", "win")).join(wins, "win")
    found = found.withColumn("dfold", F.col("pos") >= 2 * F.col("n_win"))
    pos = F.when(F.col("dfold"), F.col("pos") - 2 * F.col("n_win")).otherwise(F.col("pos") % F.col("n_win"))
    found = found.withColumn("shift", (pos - F.col("ipos")).cast("int"))
    line = ["doc_id", "text_key", "item_id", "ifold", "dfold", "shift"]
    found = found.groupBy(*line, "ipos").agg(F.max("form").alias("form"), F.max("n_item").alias("n_item"), F.max("n_form").alias("n_form"))
    found = found.groupBy(*line).agg(F.min("ipos").alias("first"), (F.max("ipos") + window - 1).alias("last"), F.count("*").alias("n_windows"), F.count_if("form").alias("forms"), F.max("n_item").alias("n_item"), F.max("n_form").alias("n_form"))
    found = found.withColumn("whole", F.col("n_windows") < F.least(F.lit(need), "n_item")).where(~F.col("whole") | ((F.col("forms") >= F.col("n_form")) & (F.col("shift") >= 0) & (F.col("n_form") < F.least(F.lit(need), "n_item"))))
    last = F.when(F.col("whole"), F.col("n_item") + window - 2).otherwise(F.col("last"))
    return found.withColumns({"first": F.when(F.col("whole"), 0).otherwise(F.col("first")), "last": last}).drop("n_item", "n_form", "forms")


def leaks(docs: DataFrame, items: DataFrame, window: int = 8, least_tokens: int = 4, need: int = 3, broadcast_rows: int = 500_000) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) to alignments with column same (no slot differs); inconsistent ones are left out."""
    items = items.select("item_id", "text").where("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"))
    items = with_tokens(items).withColumn("tpl", template()).withColumn("places", places("tpl"))
    own = items.select("item_id", F.lit(False).alias("ifold"), "tok", "low", "tpl", F.col("low").alias("value"), "n_tok")
    short = items.where((F.size("places") < F.col("n_tok")) & (F.size("places") >= window)).withColumn("value", runs("low"))
    short = short.select("item_id", F.lit(True).alias("ifold"), *(folded(c).alias(c) for c in ("tok", "low", "tpl")), "value", F.size("places").alias("n_tok"))
    items = written(own.unionByName(short), "items")
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    made = with_tokens(keyed.where("text is not null")).select("doc_id", "text_key", "tok", "low", "n_tok")
    long_ones = _hits(made, items.where(F.col("n_tok") >= window), window, need, broadcast_rows, True)
    short_ones = _hits(made, items.where((F.col("n_tok") < window) & (F.col("n_tok") >= least_tokens)), least_tokens, window, broadcast_rows, False)
    both = [x for x in (long_ones, short_ones) if x is not None]
    found = both[0].unionByName(both[1]) if len(both) == 2 else both[0] if both else made.select("doc_id", "text_key", F.lit(None).cast("bigint").alias("item_id"), *(F.lit(False).alias(c) for c in ("ifold", "dfold")), *(F.lit(0).alias(c) for c in ("shift", "first", "last")), F.lit(0).cast("bigint").alias("n_windows"), F.lit(False).alias("whole")).where("false")
    found = written(found, "alignments")
    few = found.count() <= broadcast_rows
    # slot values of the aligned parts, from the documents found only
    hits = found.withColumnsRenamed({"doc_id": "d", "text_key": "k"})
    at = keyed.where("text is not null").join(F.broadcast(hits) if few else hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k"))).drop("d", "k")
    at = with_tokens(at).withColumn("dtpl", template()).withColumn("places", F.when(F.col("dfold"), places("dtpl"))).withColumnRenamed("low", "dtok").drop("text", "tok", "n_tok")
    either = lambda x, c: F.when(F.col("dfold"), x).otherwise(F.col(c))
    at = at.withColumn("dvalue", either(runs("dtok"), "dtok")).withColumns({c: either(folded(c), c) for c in ("dtpl", "dtok")}).drop("places")
    own = items.select(F.col("item_id").alias("i"), F.col("ifold").alias("f"), F.col("low").alias("tok"), "tpl", "value")
    at = at.join(own, (F.col("item_id") == F.col("i")) & (F.col("ifold") == F.col("f"))).drop("i", "f")
    span = F.col("last") - F.col("first") + 1
    cut = lambda c, shift: F.slice(F.col(c), F.col("first") + shift + 1, span)
    at = at.where(~F.col("whole") | (F.slice("dtpl", F.col("shift") + 1, span) == F.col("tpl"))).drop("dtpl", "whole")
    theirs = F.arrays_zip(cut("tpl", F.lit(0)).alias("t"), cut("tok", F.lit(0)).alias("i"), cut("value", F.lit(0)).alias("v"))
    ours = F.arrays_zip(cut("dtok", F.col("shift")).alias("d"), cut("dvalue", F.col("shift")).alias("v"))
    slots = F.zip_with(theirs, ours, lambda a, b: F.struct(a["t"].alias("t"), a["i"].alias("i"), b["d"].alias("d"), (a["v"] == b["v"]).alias("same")))
    at = at.withColumn("slots", F.array_distinct(F.filter(slots, lambda s: s["t"].startswith("<")))).drop("tok", "tpl", "value", "dtok", "dvalue")
    different = lambda *names: F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(*(s[c] for c in names)))))
    at = at.withColumn("same", F.forall("slots", lambda s: s["same"])).where(different("t", "i") == different("t", "i", "d")).drop("slots")
    return at.dropDuplicates(["doc_id", "text_key", "item_id", "ifold", "dfold", "shift"])


def unsearched(items: DataFrame, least_tokens: int = 4) -> DataFrame:
    """The rows of items(item_id, text) that no document is searched for: null texts, and those of fewer tokens."""
    made = with_tokens(items.select("item_id", "text"))
    return made.where(F.col("text").isNull() | (F.col("low")[0] == "") | (F.col("n_tok") < least_tokens)).select("item_id", "text")


def decontaminate(docs: DataFrame, items: DataFrame, **limits) -> DataFrame:
    """docs with columns contaminated, item_id (the smallest found), n_items, n_windows and reparameterised (only found with other values).

    Input columns of these names are replaced. limits: as for leaks().
    """
    flags = leaks(docs, items, **limits).groupBy("doc_id", "text_key", "item_id", "ifold", "dfold").agg(F.sum("n_windows").alias("n_windows"), F.bool_or("same").alias("same"))
    flags = flags.groupBy("doc_id", "text_key", "item_id").agg(F.max("n_windows").alias("n_windows"), F.bool_or("same").alias("same"))
    flags = flags.groupBy("doc_id", "text_key").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"), F.sum("n_windows").alias("n_windows"), (~F.bool_or("same")).alias("reparameterised"))
    flags = flags.withColumnsRenamed({"doc_id": "id", "text_key": "key"})
    made = ["contaminated", "item_id", "n_items", "n_windows", "reparameterised"]
    kept = [c for c in docs.columns if c not in made]
    rows = docs.select(F.struct(*(docs[c] for c in kept)).alias("row"))  # so no name of docs meets those made here
    out = rows.join(flags, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("row.text") == F.col("key")), "left")
    fill = {"contaminated": F.col("key").isNotNull(), "n_items": F.coalesce("n_items", F.lit(0)), "n_windows": F.coalesce("n_windows", F.lit(0)), "reparameterised": F.coalesce("reparameterised", F.lit(False))}
    return out.withColumns(fill).select("row.*", *made)


def drop_contaminated(docs: DataFrame, items: DataFrame, **limits) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item."""
    found = leaks(docs, items, **limits).select(F.col("doc_id").alias("_leak_id"), F.col("text_key").alias("_leak_key")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_leak_id"]) & (F.xxhash64(docs["text"]) == found["_leak_key"]), "left_anti")
