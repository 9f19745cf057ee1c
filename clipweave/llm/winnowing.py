"""Benchmark decontamination by winnowing, in DataFrame functions only."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipweave.functions.rows import compute_once
from clipweave.llm.common import keep

#: Words of a window, and of a fingerprinted gram.  Both may be passed.
SPAN, GRAM = 10, 5
#: Fixed by the definition of a word: everything ASCII but digits and small letters parts words.
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> Column:
    """Words of a text: A-Z in lower case, runs of digits, letters and all beyond ASCII; null has none."""
    lowered = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.array_remove(F.split(lowered, _BREAK), "")


def _span(lo: Column, hi: Column) -> Column:
    """lo, lo + 1, ... hi; empty if hi < lo."""
    return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def with_fingerprints(df: DataFrame, text: str, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Add ``n_words`` and ``prints``, an array of (s, windows, g): the winnowed grams.

    Of every span - gram + 1 consecutive grams the smallest hash is kept.  Those grams cover one
    window of ``span`` words, so texts that share such a window keep the same gram in it.  A print
    holds the first window that keeps ``g`` and how many windows in a row do; there are about two
    prints in span - gram + 2 words.  Texts of fewer words have none.
    """
    # compute_once: a lambda must find a finished array, not one that is computed for each element.
    df = compute_once(df, "_words", words_of(text)).withColumn("n_words", F.size("_words"))
    df = compute_once(df, "_hashes", F.transform("_words", lambda w: F.xxhash64(w))).drop("_words")
    at = lambda i: F.xxhash64(*[F.get("_hashes", i + j) for j in range(gram)])
    df = compute_once(df, "_grams", F.transform(_span(F.lit(0), F.col("n_words") - gram), at)).drop("_hashes")
    last = F.col("n_words") - span
    least = lambda s: F.least(*[F.get("_grams", s + j) for j in range(span - gram + 1)])
    df = compute_once(df, "_least", F.transform(_span(F.lit(0), last), least)).drop("_grams")
    fresh = F.filter(_span(F.lit(0), last), lambda s: (s == 0) | (F.get("_least", s) != F.get("_least", s - 1)))
    df = compute_once(df, "_fresh", fresh)
    run = lambda s, j: F.struct(
        s.alias("s"), (F.coalesce(F.get("_fresh", j + 1), last + 1) - s).alias("windows"), F.get("_least", s).alias("g")
    )
    return df.withColumn("prints", F.transform("_fresh", run)).drop("_least", "_fresh")


def _windows(df: DataFrame, keys: list[str], starts: Column) -> DataFrame:
    """(keys, s, len, window): the words of ``df._words`` from each (s, len) of ``starts`` on."""
    cut = lambda x: F.struct(
        x["s"].alias("s"), x["len"].alias("len"), F.array_join(F.slice("_words", x["s"] + 1, x["len"]), " ").alias("window")
    )
    return df.select(*keys, F.inline(F.transform(starts, cut)))


def _place(s: Column, length: Column | int) -> Column:
    return F.struct(s.cast("int").alias("s"), (F.lit(length) if isinstance(length, int) else length).alias("len"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM
) -> tuple[DataFrame, DataFrame]:
    """Words of ``docs (doc_id, text)`` that lie in a passage of ``benchmark (item_id, text)``.

    1. One pass over the documents keeps, per row, its number of words and its winnowed grams.
    2. Grams that the benchmark keeps too are hits; only documents with hits are read again.
    3. A hit is extended to every window of ``span`` words that keeps its gram.  Windows are compared as words
       with the benchmark's, so hash collisions add nothing; a shared window is never missed.
    Items of fewer than ``span`` words are one window each.  Winnowing says nothing about them, so for
    each such length in the benchmark (at most span - 1) all grams of that length are looked up.

    Every stage is keyed by document or by gram.  A document is never paired with items: windows
    lead to the *set* of their items, and a set is resolved once for all documents that share it.
    Texts of documents are shuffled once, to meet their hits.  Other sides of joins are broadcast only where
    Spark finds their written size below its threshold.

    Null, empty or blank texts: no words, no hits.  Repeated rows: equal results; rows under one id are
    told apart by their text.  A null doc_id is kept as it is.  Items with one item_id count once, a null
    item_id counts as an item with an empty name.  Other columns are ignored.  Empty benchmark: no
    hits.  Empty documents: no rows.

    Returns (documents, passages): doc_id, n_words, n_hit, items (sorted array) for each row, and
    doc_id, first, n_words for each run of hit words.
    """
    items = compute_once(
        benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")),
        "_words",
        words_of("text"),
    ).withColumn("_n", F.size("_words"))
    whole = F.array(_place(F.lit(0), F.col("_n")))
    sliding = F.transform(_span(F.lit(0), F.col("_n") - span), lambda s: _place(s, span))
    passages = _windows(items.where("_n > 0"), ["item"], F.when(F.col("_n") < span, whole).otherwise(sliding))
    sets = passages.groupBy("window", "len").agg(F.sort_array(F.collect_set("item")).alias("items"))
    named = keep(sets.withColumn("set", F.sha2(F.to_json("items"), 256)), "windows")
    known = named.select("window", "len", "set")
    item_prints = with_fingerprints(items.where(F.col("_n") >= span).select("text"), "text", span, gram)
    marks = keep(item_prints.select(F.explode("prints.g").alias("g")).distinct(), "marks")

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("key", F.unhex(F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(""), "text"), 256)))
    base = keep(with_fingerprints(own, "text", span, gram).select("doc_id", "key", "n_words", "prints"), "prints")
    found = base.select(F.xxhash64("key").alias("k"), F.inline("prints")).join(marks, "g", "left_semi")
    around = _span(F.col("s"), F.col("s") + F.col("windows") - 1)
    places = found.select("k", F.explode(F.transform(around, lambda s: _place(s, span))).alias("place"))
    lengths = [r[0] for r in named.where(F.col("len") < span).select("len").distinct().collect()]
    if lengths:
        places = places.union(_short_places(own, named, sorted(lengths)))
    places = keep(places.groupBy("k").agg(F.collect_set("place").alias("places")), "places")

    # Documents are shuffled at every size: how many have hits grows with the input and is no broadcast.
    hit_docs = own.join(places.hint("merge"), F.xxhash64("key") == F.col("k"))
    hit_docs = compute_once(hit_docs, "_words", words_of("text")).select("key", "_words", "places")
    hits = _windows(hit_docs, ["key"], F.col("places")).join(known, ["window", "len"])
    per_doc = hits.groupBy("key").agg(
        F.array_sort(F.collect_set(_place(F.col("s"), F.col("len")))).alias("spans"),
        F.sort_array(F.collect_set("set")).alias("sets"),
    )
    per_doc = keep(per_doc.withColumn("sig", F.sha2(F.to_json("sets"), 256)), "hits")
    # One row per distinct combination of item sets, however many documents share it.
    combos = per_doc.groupBy("sig").agg(F.first("sets").alias("sets")).select("sig", F.explode("sets").alias("set"))
    members = named.groupBy("set").agg(F.first("items").alias("items"))
    resolved = combos.join(members, "set").select("sig", F.explode("items").alias("item"))
    resolved = resolved.groupBy("sig").agg(F.sort_array(F.collect_set("item")).alias("items"))

    runs = keep(per_doc.join(resolved, "sig").select("key", "items", _merged("spans").alias("runs")), "runs")
    base = base.select("doc_id", "key", "n_words")
    counted = base.join(runs, "key", "left").select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce(F.aggregate("runs", F.lit(0), lambda a, r: a + r["n_words"]), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
    return counted, base.select("doc_id", "key").join(runs, "key").select("doc_id", F.inline("runs"))


def _short_places(docs: DataFrame, named: DataFrame, lengths: list[int]) -> DataFrame:
    """(k, place) of grams as long as a short item whose hash is that of such an item."""
    short = named.where(F.col("len").isin(lengths)).select("len", F.xxhash64("window").alias("g")).distinct()
    docs = compute_once(docs.select("key", "text"), "_words", words_of("text"))

    def grams_of(n: int) -> Column:
        gram = lambda s: F.xxhash64(F.array_join(F.slice("_words", s + 1, n), " "))
        row = lambda s: F.struct(s.alias("s"), F.lit(n).alias("len"), gram(s).alias("g"))
        return F.transform(_span(F.lit(0), F.size("_words") - n), row)

    grams = docs.select(F.xxhash64("key").alias("k"), F.inline(F.concat(*map(grams_of, lengths))))
    return grams.join(short, ["len", "g"], "left_semi").select("k", _place(F.col("s"), F.col("len")).alias("place"))


def _merged(spans: str) -> Column:
    """Sorted (s, len) as the runs (first, n_words) that they cover."""
    none = F.array().cast("array<struct<first:int,n_words:int>>")
    run = lambda first, n: F.struct(first.cast("int").alias("first"), n.cast("int").alias("n_words"))

    def step(acc: Column, x: Column) -> Column:
        end = x["s"] + x["len"]
        far = acc["first"] + acc["n"]
        apart = acc["first"].isNull() | (x["s"] > far)
        return F.struct(
            F.when(apart & acc["first"].isNotNull(), F.concat(acc["done"], F.array(run(acc["first"], acc["n"])))).otherwise(acc["done"]).alias("done"),
            F.when(apart, x["s"]).otherwise(acc["first"]).alias("first"),
            F.when(apart, x["len"]).otherwise(F.greatest(far, end) - acc["first"]).alias("n"),
        )

    start = F.struct(none.alias("done"), F.lit(None).cast("int").alias("first"), F.lit(0).alias("n"))
    close = lambda acc: F.concat(acc["done"], F.array(run(acc["first"], acc["n"])))
    return F.aggregate(spans, start, step, close)


def digest(counted: DataFrame) -> DataFrame:
    """The result as counts and a hash of the item names."""
    return counted.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
