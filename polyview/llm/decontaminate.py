"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations alone.

Words are compared in lower case. A text overlaps an item where some WINDOW consecutive words of the item (all of a shorter
item) stand in the text in the same places but for at most ``2 * words // WINDOW`` substituted ones. A mask
names the word positions that a seed looks at; each window with so few substitutions agrees with the item on
one of MASKS wholly (two masks of six words for windows of 13, checked over all placements; a run of
three words for items under WINDOW words), so the equal hashes of seeds find every overlap. Each hit is verified on the
words around it, in the row where it was found. The texts are never shuffled. While the items' seeds are fewer than
MAX_BROADCAST, they are broadcast, each with the words within a window of it. Beyond that, the hashes of both sides are shuffled, one short
row a position, and the places of the hits alone, again by broadcast or shuffle, go back to the texts.

Items of fewer than MIN_WORDS words, null or empty, match nothing, as do null and empty texts. Repeated items are reported each
by its id, and rows of one document id are reported together. Columns other than ids and texts are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyview.llm.common import SPACES, stored, without

WINDOW, MIN_WORDS = 13, 6
#: Positions that a seed compares: the first two for items of WINDOW words and more, the last for shorter ones.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8), (0, 1, 2))
MAX_BROADCAST = 400_000


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), SPACES), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed(words: Column, at: Column, mask: int) -> Column:
    return F.xxhash64(F.lit(mask), *[F.get(words, at + o) for o in MASKS[mask]])


def seeds(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """h (a seed's hash), item_id, q (its place in the item), n (the item's words), w (words of the window, allowed
    substitutions in miss), near (the words from lo on that windows around the seed can hold)."""
    items = benchmark.select(F.col(item_id).alias("item_id"), word_hashes(F.col(text)).alias("i")).withColumn("n", F.size("i")).where(F.col("n") >= MIN_WORDS)
    items = items.select("*", F.least("n", F.lit(WINDOW)).alias("w")).withColumn("miss", F.floor(2 * F.col("w") / WINDOW).cast("int"))
    each = []
    for k, mask in enumerate(MASKS):
        span = mask[-1] + 1
        own = items.where((F.col("n") >= WINDOW) == F.lit(k < 2))
        own = own.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - span)).alias("q"))
        lo, hi = F.greatest(F.lit(0), F.col("q") + span - F.col("w")), F.least(F.col("n"), F.col("q") + F.col("w"))
        each.append(own.select(_seed(F.col("i"), F.col("q"), k).alias("h"), "item_id", "q", "w", "miss", lo.alias("lo"), F.slice("i", lo + 1, hi - lo).alias("near")))
    return each[0].unionByName(each[1]).unionByName(each[2])


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item that overlap: doc_id, item_id, first_word and last_word (places in the text of the
    first and last word of overlapping windows, from 0) and best (most equal words in a window)."""
    known = seeds(benchmark, item_id, item_text)
    some = {r["short"]: r["n"] for r in known.groupBy((F.col("w") < WINDOW).alias("short")).agg(F.count("*").alias("n")).collect()}
    used = [k for k in range(len(MASKS)) if some.get(k == 2)]
    own = docs.select(F.col(doc_id).alias("doc_id"), word_hashes(F.col(text)).alias("d"))
    # outer: else the planner adds a filter that computes the words twice
    at = own.select("doc_id", "d", F.explode_outer(F.sequence(F.lit(0), F.size("d") - 1)).alias("p"))
    tried = at.select("doc_id", "d", "p", F.explode(F.array(*[_seed(F.col("d"), F.col("p"), k) for k in used or [0]])).alias("h"))
    if sum(some.values()) <= MAX_BROADCAST:
        tried = tried.join(F.broadcast(known), "h")
    else:
        # A text is known by its hash here; if two share one, windows are tried in both, and verified.
        places = tried.select("doc_id", F.xxhash64("d").alias("_t"), "p", "h").distinct()
        places = stored(places.join(known, "h").drop("h"), "hits")
        few = places.count() <= MAX_BROADCAST
        places = places.withColumnsRenamed({"doc_id": "_d"})
        own = own.withColumn("_k", F.xxhash64("d"))
        tried = own.join(F.broadcast(places) if few else places, (F.col("_k") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    # Only the words around a hit leave the stage in which the text is read, not the text. The last column keeps the planner
    # from moving the verification, which isn't compiled, into the join.
    start = F.col("p") - F.col("q") + F.col("lo")
    first = F.greatest(start, F.lit(0))
    hits = tried.select(
        "doc_id", "item_id", "w", "miss", "near", start.alias("start"), F.size("d").alias("size"), F.slice("d", first + 1, F.greatest(F.lit(0), F.size("near") - (first - start))).alias("own"), (first - start).alias("skip"), F.monotonically_increasing_id().alias("_apart")
    )
    # Equal words at each place of the item's stretch, then each window in it.
    equal = F.transform(F.sequence(F.lit(0), F.size("near") - 1), lambda k: F.coalesce((F.get("own", k - F.col("skip")) == F.get("near", k)).cast("int"), F.lit(0)))
    windows = F.transform(F.sequence(F.lit(0), F.size("near") - F.col("w")), lambda k: F.struct(F.aggregate(F.slice("equal", k + 1, F.col("w")), F.lit(0), lambda a, x: a + x).alias("same"), (F.col("start") + k).alias("at")))
    fits = F.filter(windows, lambda x: (x["same"] >= F.col("w") - F.col("miss")) & (x["at"] >= 0) & (x["at"] + F.col("w") <= F.col("size")))
    found = hits.withColumn("equal", equal).withColumn("fits", fits).where((F.size("fits") > 0) & (F.col("_apart") >= 0))
    found = found.select("doc_id", "item_id", F.array_min(F.transform("fits", lambda x: x["at"])).alias("a"), (F.array_max(F.transform("fits", lambda x: x["at"])) + F.col("w") - 1).alias("b"), F.array_max(F.transform("fits", lambda x: x["same"])).alias("m"))
    return found.groupBy("doc_id", "item_id").agg(F.min("a").cast("long").alias("first_word"), F.max("b").cast("long").alias("last_word"), F.max("m").cast("long").alias("best"))


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows whose id overlaps an item; rows without an id stay."""
    return without(docs, overlaps(docs, benchmark, doc_id, text).select("doc_id"), doc_id)
