"""Winnowing against a benchmark, in DataFrame operations only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch as S

#: Benchmark windows up to this many are broadcast (some 100 bytes each); beyond, the join shuffles.
BROADCAST_WINDOWS = 500_000
#: What isn't part of a word, once A-Z are lower case.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def lowered(text: Column) -> Column:
    """A-Z only; the quick built-in where no other letters can be in the text."""
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), BREAK), "")


def grams(w: Column, k: int) -> Column:
    """Hashes of the k-grams of an array of words, by start; none if it is shorter."""
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k), F.lit(k)))).otherwise(F.array().cast("array<bigint>"))


def minima(h: Column, w: int) -> Column:
    """The places of the first least hash of each window of w hashes, each once."""
    places = F.transform(F.sequence(F.lit(1), F.size(h) - (w - 1)), lambda i: let(F.slice(h, i, w), lambda s: i + F.array_position(s, F.array_min(s)).cast("int") - 1))
    return F.when(F.size(h) >= w, F.array_distinct(places)).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, n: int, k: int) -> DataFrame:
    """Distinct windows of the benchmark: win (text), len, items, and the fingerprint to meet documents by:
    fp, k-gram length size, off words after the window's start."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(n))
    win = items.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.slice("w", i, length))).alias("v"))
    win = win.groupBy("v").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    full = let(grams(F.col("v"), k), lambda h: F.struct(F.array_min(h).alias("fp"), (F.array_position(h, F.array_min(h)) - 1).cast("int").alias("off"), F.lit(k).alias("size")))
    short = F.struct(F.xxhash64(F.col("v"), F.size("v")).alias("fp"), F.lit(0).alias("off"), F.size("v").alias("size"))
    print_ = F.when(F.size("v") == n, full).otherwise(short)
    return win.select(print_.alias("p"), F.array_join("v", " ").alias("win"), F.size("v").alias("len"), "items").select("p.*", "win", "len", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, k: int = 5) -> DataFrame:
    """Which words of each document (doc_id, text) lie in a window of n benchmark words that occurs in it.

    Fingerprints are the least k-gram hash of each n-word window, that is of n - k + 1 k-grams, and its place: a
    window that both sides hold has the same least hash first at the same place in both, so each shared span of n
    words and more meets in the join. From there it is extended: the window's own words are compared, word by word,
    around the place of the hash - one comparison for each place and window that met. An item shorter than n but not
    empty is one window, met by the hash of all its words.

    Returns every row with n_words, n_hit, items (sorted ids), contaminated, which replace columns of these names; all
    others stay. Null and empty texts have no words; an item without words has no windows, one without
    id is never listed; without items nothing is hit, without documents there are no rows. Equal ids with different texts are told apart by the
    text's hash; repeated rows and ties each count; very long texts are read whole.
    """
    bench = S.saved(benchmark_windows(benchmark, n, k), f"{S.scratch(docs.sparkSession, 'winnowing')}/windows")
    lens = sorted(r[0] for r in bench.where(F.col("len") < n).select("len").distinct().collect())  # fewer than n
    count = bench.count()
    # A row for each fingerprint, with the windows that it stands for.
    prints = bench.groupBy("size", "fp").agg(F.collect_list(F.struct("off", "len", "win", "items")).alias("windows")).select("windows", F.col("size").alias("psize"), F.col("fp").alias("pfp"))
    hint = F.broadcast if count <= BROADCAST_WINDOWS else lambda x: x
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"))

    def marks(w: Column) -> Column:
        """(k-gram size, hash, place) of the fingerprints of an array of words."""
        at = lambda h, size: lambda p: F.struct(F.lit(size).alias("size"), F.get(h, p - 1).alias("fp"), p.alias("at"))
        found = let(grams(w, k), lambda h: F.transform(minima(h, n - k + 1), at(h, k)))
        each = lambda m: F.transform(grams(w, m), lambda h, i: F.struct(F.lit(m).alias("size"), h.alias("fp"), (i + 1).alias("at")))
        return F.flatten(F.array(found, *map(each, lens)))

    exploded = held.select("id", "th", F.explode(let(words(F.col("row.text")), marks)).alias("m")).select("id", "th", "m.*")
    met = exploded.join(hint(prints), (F.col("fp") == F.col("pfp")) & (F.col("size") == F.col("psize")))
    # Repeated rows make the same meetings: one of each is enough.
    met = met.groupBy("id", "th").agg(F.collect_set(F.struct("at", "windows")).alias("all")).select(F.col("id").alias("of"), F.col("th").alias("of_th"), "all")

    def starts(w: Column) -> Column:
        """(start, end, items) of each window that occurs."""
        begun = lambda m: lambda x: F.struct((m["at"] - x["off"]).alias("start"), (m["at"] - x["off"] + x["len"]).alias("end"), x["items"].alias("items"))
        occurs = lambda m: lambda x: (m["at"] > x["off"]) & (F.array_join(F.slice(w, F.greatest(m["at"] - x["off"], F.lit(1)), x["len"]), " ") == x["win"])
        return F.flatten(F.transform("all", lambda m: F.transform(F.filter(m["windows"], occurs(m)), begun(m))))

    fits = F.col("id").eqNullSafe(F.col("of")) & F.col("th").eqNullSafe(F.col("of_th"))
    none = F.array().cast("array<struct<start:int,end:int,items:array<bigint>>>")
    hits = F.when(F.col("all").isNull(), none).otherwise(F.sort_array(let(words(F.col("row.text")), starts)))
    both = held.join(met, fits, "left").select("row", F.size(words(F.col("row.text"))).cast("long").alias("n_words"), hits.alias("hits"))
    swept = F.aggregate("hits", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, x: F.struct(F.greatest(a["end"], x["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["start"]))).alias("n")))
    items = F.array_distinct(F.flatten(F.transform("hits", lambda x: x["items"])))
    added = {"n_words": F.col("n_words"), "n_hit": F.col("n_hit"), "items": items, "contaminated": F.col("n_hit") > 0}
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in added]
    return both.withColumn("n_hit", swept["n"].cast("long")).select(*kept, *[c.alias(x) for x, c in added.items()])
