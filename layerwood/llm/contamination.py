"""Benchmark decontamination on a positional inverted index, in DataFrame functions only.

The index lists where a term stands: document, position.  A window is 13
consecutive words of a benchmark item (a shorter item is one window).  The
corpus counts of benchmark terms tell the two rarest terms of every window; only
lists of such terms are made.  A window's places are its rarest term's list
shifted by the term's offset, intersected with the shifted list of the second
rarest.  What is left is compared word for word with the texts, of which only
those with such a place are read again.  ``proximity_matches`` answers from the
same lists where two terms stand close together, though not as in the window.

Keys of a text are two 64-bit hashes, of its id and of its content: rows that
are equal in both are one text in the index and one row each in the result.

Sides that are small by nature (benchmark terms, windows, texts with a place)
are counted first and sent to all tasks only up to ``SEND_ROWS`` rows; beyond
that the same join shuffles.

Defined cases: null and empty texts have no words; items without words have no
window; item ids that repeat are one item; empty tables give no hits; a null item
id is left out of lists of ids; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The words of a text whose letters are not lowered yet.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEND_ROWS = 400_000
KEY = ["id_hash", "text_hash"]


def pieces(text: Column) -> Column:
    """Lower-cased words; the first and the last may be empty."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN)


def leading(text: Column) -> Column:
    """How many empty pieces come first."""
    return (~F.coalesce(text, F.lit("")).rlike(rf"^{WORD}")).cast("int")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small(df: DataFrame, rows: int = SEND_ROWS) -> DataFrame:
    """Hint to send df to all tasks if it has few rows; df should be a written table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.xxhash64(F.lit(1), F.col(key).cast("string")).alias("id_hash"),
                       F.xxhash64(F.lit(2), text).alias("text_hash"), F.col(text).alias("text"))


def item_windows(items: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Distinct windows: window (its hash), n, words, and the ids of the items that have it."""
    words = F.filter(pieces(F.col(text)), lambda w: w != "")
    rows = items.select(F.col(key).cast("string").alias("item"), words.alias("words")).filter(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(size))
    starts = F.sequence(F.lit(1), F.size("words") - n + 1)
    rows = rows.select("item", n.alias("n"), "words", F.explode(starts).alias("start"))
    rows = rows.select("item", "n", F.slice("words", F.col("start"), F.col("n")).alias("words"))
    rows = rows.withColumn("window", F.md5(F.array_join("words", " ").cast("binary")))
    return rows.groupBy("window").agg(F.first("n").alias("n"), F.first("words").alias("words"), F.collect_set("item").alias("items"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of the terms stands in the corpus; absent ones have no row."""
    rows = docs.select(F.explode(pieces(F.col("text"))).alias("term"))
    return rows.join(small(terms), "term", "left_semi").groupBy("term").count()


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index lists of the given terms: term, key, pos (from 0)."""
    rows = docs.select(*KEY, leading(F.col("text")).alias("lead"), F.posexplode(pieces(F.col("text"))).alias("pos", "term"))
    rows = rows.join(small(terms), "term", "left_semi")
    return rows.select("term", *KEY, (F.col("pos") - F.col("lead")).alias("pos"))


def rarest_terms(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows all of whose terms occur, with their rarest and second rarest term and offset."""
    rows = windows.select("window", "n", F.posexplode("words").alias("offset", "term")).join(counts, "term")
    order = Window.partitionBy("window").orderBy("count", "offset")
    rows = rows.withColumns({"nth": F.row_number().over(order), "found": F.count("*").over(Window.partitionBy("window"))})
    rows = rows.filter((F.col("found") == F.col("n")) & (F.col("nth") <= 2))
    pick = lambda nth, c: F.max(F.when(F.col("nth") == nth, F.col(c)))
    return rows.groupBy("window").agg(pick(1, "term").alias("term1"), pick(1, "offset").alias("offset1"),
                                      pick(2, "term").alias("term2"), pick(2, "offset").alias("offset2"))


def places(lists: DataFrame, rare: DataFrame) -> DataFrame:
    """window, key and start where the lists of both rarest terms agree."""
    first = lists.join(small(rare), F.col("term") == F.col("term1"))
    first = first.select("window", "term2", "offset2", *KEY, (F.col("pos") - F.col("offset1")).alias("start")).filter("start >= 0")
    second = lists.select(F.col("term").alias("term2"), *KEY, F.col("pos").alias("pos2")).distinct()
    both = first.filter("term2 IS NOT NULL").withColumn("pos2", F.col("start") + F.col("offset2"))
    both = both.join(second, ["term2", *KEY, "pos2"], "left_semi")
    columns = ["window", *KEY, "start"]
    return both.select(columns).unionByName(first.filter("term2 IS NULL").select(columns)).distinct()


def proximity_matches(lists: DataFrame, rare: DataFrame, slop: int = 8) -> DataFrame:
    """window, key, pos1, pos2: its two rarest terms at most ``slop`` words apart, but not at their distance in the window.

    Places are compared by stretches of ``slop`` words, own and next ones, so a
    frequent term in a long text is not paired with itself throughout.
    """
    side = F.floor(F.col("pos") / slop)
    first = lists.join(small(rare.filter("term2 IS NOT NULL")), F.col("term") == F.col("term1"))
    first = first.select("window", "term2", (F.col("offset2") - F.col("offset1")).alias("distance"), *KEY,
                         F.col("pos").alias("pos1"), F.explode(F.array(side - 1, side, side + 1)).alias("side"))
    second = lists.select(F.col("term").alias("term2"), *KEY, F.col("pos").alias("pos2"), side.alias("side"))
    rows = first.join(second, ["term2", *KEY, "side"])
    apart = F.col("pos2") - F.col("pos1")
    return rows.filter((F.abs(apart) <= slop) & (apart != F.col("distance"))).select("window", *KEY, "pos1", "pos2").distinct()


def exact_places(docs: DataFrame, found: DataFrame, windows: DataFrame) -> DataFrame:
    """The places whose words equal the window's: window, n, key, start."""
    keys = materialize(found.select(KEY).distinct(), "keys")
    words = F.filter(pieces(F.col("text")), lambda w: w != "")
    texts = docs.join(small(keys), KEY, "left_semi").select(*KEY, words.alias("all_words")).dropDuplicates(KEY)
    wanted = found.join(small(windows.select("window", "n", "words")), "window")
    wanted = wanted.groupBy(KEY).agg(F.collect_list(F.struct("window", "n", "start", "words")).alias("places"))
    same = F.filter("places", lambda p: F.slice("all_words", p["start"] + 1, p["n"]) == p["words"])
    rows = texts.join(wanted, KEY).select(*KEY, F.explode(same).alias("place"))
    return rows.select(*KEY, "place.window", "place.n", "place.start")


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                  item_text: str = "text", window: int = 13) -> DataFrame:
    """All columns of docs, and n_words, n_hit (words inside a window's occurrence) and items (ids as text, sorted)."""
    docs = docs.drop("n_words", "n_hit", "items")  # columns of these names are replaced
    texts = keyed(docs, key, text)
    windows = materialize(item_windows(items, item_key, item_text, window), "windows")
    terms = materialize(windows.select(F.explode("words").alias("term")).distinct(), "terms")
    counts = materialize(term_counts(texts, terms), "counts")
    rare = materialize(rarest_terms(windows, counts), "rare")
    anchors = materialize(rare.select(F.explode(F.array("term1", "term2")).alias("term")).filter("term IS NOT NULL").distinct(), "anchors")
    lists = materialize(postings(texts, anchors), "postings")
    found = materialize(places(lists, rare), "places")
    exact = materialize(exact_places(texts, found, windows), "exact")
    # words covered: what each place adds behind the places before it
    spans = exact.groupBy(*KEY, "start").agg((F.col("start") + F.max("n")).alias("end"))
    before = Window.partitionBy(*KEY).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0)))
    covered = spans.withColumn("new", F.greatest(F.col("end") - reached, F.lit(0))).groupBy(KEY).agg(F.sum("new").cast("long").alias("n_hit"))
    named = exact.select(*KEY, "window").distinct().join(windows.select("window", F.explode("items").alias("item")), "window")
    named = named.groupBy(KEY).agg(F.sort_array(F.collect_set("item")).alias("items"))
    hits = covered.join(named, KEY, "left")
    keys = {k: f"_{k}" for k in KEY}
    rows = docs.withColumns({keys["id_hash"]: F.xxhash64(F.lit(1), F.col(key).cast("string")),
                             keys["text_hash"]: F.xxhash64(F.lit(2), text), "n_words": word_count(F.col(text))})
    hits = small(materialize(hits.withColumnsRenamed(keys), "hits"))
    rows = rows.join(hits, list(keys.values()), "left").drop(*keys.values())
    return rows.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")),
                             "items": F.coalesce("items", F.array().cast("array<string>"))})
