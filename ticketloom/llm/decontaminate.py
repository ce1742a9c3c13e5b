"""Benchmark decontamination by templates.

Texts become sequences of words in which numbers, names and units are typed
placeholders: <num>, <name> (a capitalised word inside a sentence) and <unit> (a unit
behind a number). Windows of eight template words of every document are joined by hash
to the windows of the benchmark. Where they meet, the values in the slots are compared:
an item's value must stand for one value of the document and the other way round. Where
values conflict, the value met in more than half of the places of the other one stands,
and windows with any other pair are a coincidence of templates. Windows of equal words
always count; they are also joined by the words themselves, in lower case, so passages
of names and numbers and copies in capitals are found. A document leaks an item if its
matches cover enough of the item; the leak is ``exact`` where all slots are equal and
``reparameterised`` where values were exchanged.

Items of equal template are one class, matched once and reported by their smallest
item_id and their number. Items of five to seven words are one window of their own
length; shorter items count where their words, in any case, are a whole line or sentence
of the document. Windows with fewer than five (for items below eight words: three) plain
words are matched by their words only, not by their template: a document leaks them
``exact`` or not at all.

Null and empty texts match nothing, null items are none. Every row is judged by its own
text: rows of equal or null doc_id do not add up, and equal rows share their verdict. Very
long texts are one row's arrays. Only doc_id and text are read; other columns may have any
name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ticketloom.llm.common import let, pinned, scratch_path, small_side, without, written

WINDOW = 8
LEAST_WINDOW = 5
#: Words of an item that consistent matches must cover: this share, up to this number.
COVER_SHARE = 0.6
COVER_WORDS = 13

#: Units, in lower case.
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "ft", "yard", "yards", "mile", "miles", "mph",
         "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "ton", "tons", "lb", "lbs", "pound", "pounds",
         "ounce", "ounces", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons",
         "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months",
         "year", "years", "percent", "%", "°", "€", "$", "£", "dollar", "dollars", "cent", "cents", "euro", "euros")
_MARK = "\x01"
_NUMBER = "(?<![^ ])[0-9][0-9.,]*(?![^ ])"


def _once(rows: DataFrame, keep: tuple[str, ...], text: Column) -> DataFrame:
    """keep, plain (words with single blanks between) and named (the same with names replaced).

    A word that opens a sentence carries a mark if capitalised. Each step is a column of its
    own: what a condition and its branches share would be computed for each of them.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "\x01", " ")
    t = F.regexp_replace(t, "(?:^|(?<=[.!?:\\n])|(?<=[.!?:\\n][\\s\"'(])|(?<=[.!?:\\n]\\s\\s))(?=\\p{Lu})", _MARK)
    t = F.regexp_replace(t, "(?<![0-9])[.,]|[.,](?![0-9])|[^\\p{L}\\p{M}\\p{N}.,%°€$£\x01]+", " ")
    rows = pinned(rows, *keep, t=t)
    parted = F.regexp_replace(F.regexp_replace(
        "t", "(?<=[0-9])(?=[\\p{L}%°€$£])|(?<=[€$£])(?=[0-9])", " "), "(?<=[0-9]) +", " ")
    t = F.when(F.col("t").rlike("[0-9]"), parted).otherwise(F.col("t"))
    rows = pinned(rows, *keep, plain=F.btrim(F.regexp_replace(t, " {2,}", " ")))
    return pinned(rows, *keep, "plain", named=F.regexp_replace("plain", "(?<![^ ])\\p{Lu}[^ ]*", "<name>"))


def _sequences(rows: DataFrame, text: Column, *keep: str) -> DataFrame:
    """keep, w (words as they are), c (template words), x (words in lower case); arrays of one length."""
    base = _once(rows, keep, text)
    units = "|".join(u if u.isalpha() else f"[{u}]" for u in UNITS)
    numbered = F.regexp_replace(F.regexp_replace("named", _NUMBER, "<num>"), f"(?<=<num> )(?:{units})(?![^ ])", "<unit>")
    template = F.when(F.col("named").rlike("[0-9]"), numbered).otherwise(F.col("named"))
    none = F.array().cast("array<string>")
    cut = lambda s: F.when(F.col("plain") == "", none).otherwise(F.split(s, " ", -1))
    bare = lambda s: F.lower(F.replace(s, F.lit(_MARK), F.lit("")))
    return pinned(base, *keep, w=cut(F.col("plain")), c=cut(bare(template)), x=cut(bare(F.col("plain"))))


def _hashes(words: str) -> Column:
    """A hash for each word, so that windows hash numbers and not texts."""
    return F.transform(words, lambda x: F.xxhash64(x))


def _window_hash(hashes: str, at: Column, size: int, exact: bool) -> Column:
    return F.xxhash64(F.lit(2 * size + exact), *(F.get(hashes, at + j) for j in range(size)))


def _starts(size: int) -> Column:
    """Places of windows of so many words; none in shorter texts."""
    n = F.size("c")
    return F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))


def _item_windows(items: DataFrame, size: int, exact: bool) -> DataFrame:
    """Windows of items: hash, exact, size, item_id, n_items, n, place, key (the words hashed), item_words, template."""
    own, words = ("x", "x") if exact else ("c", "w")
    rows = pinned(items.where(F.least("n", F.lit(WINDOW)) == size), "item_id", "n_items", "n", "w", "c", "x", h=_hashes(own))
    at = rows.select("*", F.explode(_starts(size)).alias("place"))
    cut = lambda a: F.slice(a, F.col("place") + 1, size)
    return at.select(_window_hash("h", F.col("place"), size, exact).alias("hash"), F.lit(exact).alias("exact"), F.lit(size).alias("size"),
                     "item_id", "n_items", "n", "place", cut(own).alias("key"), cut(words).alias("item_words"), cut("c").alias("template"))


def benchmark_classes(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items of equal template, and their different texts in lower case: item_id, n_items, w, c, x, n each.

    An item's class is named by its smallest item_id; in the second table each text stands
    with its class, one row a text.
    """
    spark = benchmark.sparkSession
    seq = _sequences(benchmark, F.col("text"), "item_id").withColumn("class", F.xxhash64(F.lit(1), "c"))
    by_text = written(seq.groupBy("class", "c", "x").agg(
        F.min(F.struct("item_id", "w")).alias("item"), F.count(F.lit(1)).alias("count")), scratch_path(spark, "benchmark-texts"))
    classes = written(by_text.groupBy("class", "c").agg(F.min("item").alias("item"), F.sum("count").alias("n_items")).select(
        "class", "item.item_id", "n_items", "item.w", "c", F.col("item.w").alias("x"), F.size("c").alias("n")).where("n > 0"),
        scratch_path(spark, "benchmark"))
    named = classes.select(F.col("class").alias("of"), F.col("c").alias("template"), "item_id", "n_items", "n")
    texts = by_text.join(named, (F.col("class") == F.col("of")) & (F.col("c") == F.col("template"))).select(
        "item_id", "n_items", "item.w", "c", "x", "n")
    return classes, texts


def _bits(index: DataFrame) -> tuple[Column, int]:
    """Which hash ends occur in the index, as one array of 64-bit words: a first sieve for windows."""
    spark = index.sparkSession
    size = min(1 << 26, max(1 << 16, 1 << (64 * index.count()).bit_length()))
    place = F.col("hash").bitwiseAND(size - 1)
    filled = index.groupBy(F.shiftright(place, 6).alias("id")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast((hash & {size - 1}) & 63 as int))")).alias("bits"))
    words = spark.range(size // 64).join(filled, "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    table = written(words.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("words")),
                    scratch_path(spark, "sieve"))
    return table.scalar(), size


def _short(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Items below LEAST_WINDOW words that stand as a whole line or sentence; rows as in ``matches``."""
    index = small_side(written(texts.where(F.col("n") < LEAST_WINDOW).select(
        "item_id", "n_items", "n", F.array_join("x", " ").alias("key"), F.col("x").alias("item_words"), "c").distinct(),
        scratch_path(docs.sparkSession, "short-items")))
    lines = docs.select("doc_id", "mark", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\\n|(?<=[.!?])\\s+")).alias("shift", "line"))
    seq = _sequences(lines.where("line <> ''"), F.col("line"), "doc_id", "mark", "shift").where(F.size("x").between(1, LEAST_WINDOW - 1))
    met = seq.select("doc_id", "mark", "shift", F.array_join("x", " ").alias("key"), "x").join(index, "key")
    return met.select("doc_id", "mark", "item_id", "n_items", "n", F.lit(0).alias("place"), F.col("n").alias("size"), "shift",
                      _slots(F.col("c"), F.col("item_words"), F.col("x"), F.lit(0)).alias("slots"))


def _slots(template: Column, item: Column, doc: Column, first: Column) -> Column:
    """(place, item, doc) of each placeholder of a matched window that begins at the item's place ``first``."""
    zipped = F.transform(F.arrays_zip(template.alias("t"), item.alias("i"), doc.alias("d")), lambda x, i: F.struct(
        x["t"].alias("template"), (first + i).alias("place"),
        F.lower(x["i"]).alias("item"), F.lower(x["d"]).alias("doc")))
    return F.transform(F.filter(zipped, lambda x: x["template"].startswith("<")), lambda x: F.struct(x["place"], x["item"], x["doc"]))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Matched windows: doc_id, mark, item_id, n_items, n, place in the item, size, shift, slots (place, item, doc).

    Windows hash the words' hashes and are sieved before anything is cut: words are copied
    only where a hash passes, and the join compares the words themselves.
    """
    spark = docs.sparkSession
    classes, texts = benchmark_classes(benchmark)
    sizes = [r[0] for r in classes.where(F.col("n") >= LEAST_WINDOW).select(F.least("n", F.lit(WINDOW)).alias("k")).distinct().sort("k").collect()]
    literal = F.size(F.filter("template", lambda x: ~x.startswith("<")))
    parts = []
    for size in sizes or [WINDOW]:
        by_template = _item_windows(classes, size, False).where(literal >= (5 if size == WINDOW else 3))
        parts += [by_template, _item_windows(texts, size, True)]
    index = written(reduce(DataFrame.union, parts).distinct(), scratch_path(spark, "windows"))
    sieve, bits = _bits(index)

    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    seq = _sequences(rows, F.col("text"), "doc_id", "mark")
    seq = pinned(seq, "doc_id", "mark", "w", "c", "x", hc=_hashes("c"), hx=_hashes("x"))

    def windows(size: int) -> DataFrame:
        """Two rows per window, by its template and by its own words, of those that pass the sieve."""
        last = (F.size("c") - size) * 2 + 1
        at = seq.where(F.size("c") >= size).select("*", F.explode(F.sequence(F.lit(0), last)).alias("p")).select(
            "doc_id", "mark", "w", "c", "x", "hc", "hx", F.shiftright("p", 1).alias("at"), (F.col("p").bitwiseAND(1) == 1).alias("exact"))
        rows = at.withColumn("hash", F.when(F.col("exact"), _window_hash("hx", F.col("at"), size, True)).otherwise(
            _window_hash("hc", F.col("at"), size, False)))
        place = F.col("hash").bitwiseAND(bits - 1)
        passed = rows.where(F.getbit(F.get(sieve, F.shiftright(place, 6).cast("int")), place.bitwiseAND(63).cast("int")) == 1)
        cut = lambda x: F.slice(x, F.col("at") + 1, size)
        either = lambda x, y: F.when(F.col("exact"), cut(x)).otherwise(cut(y))
        return passed.select("doc_id", "mark", "at", "hash", "exact", F.lit(size).alias("size"), either("x", "c").alias("own"),
                             either("x", "w").alias("words"))

    mine = reduce(DataFrame.union, map(windows, sizes or [WINDOW]))
    met = mine.join(small_side(index), ["hash", "exact", "size"]).where(F.col("own") == F.col("key"))
    out = met.select("doc_id", "mark", "item_id", "n_items", "n", "place", "size", (F.col("at") - F.col("place")).alias("shift"),
                     _slots(F.col("template"), F.col("item_words"), F.col("words"), F.col("place")).alias("slots"))
    if classes.where(F.col("n") < LEAST_WINDOW).limit(1).count():
        out = out.unionByName(_short(rows, texts))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per leaking document and item class; ``mark`` is the hash of the document's text."""
    found = matches(docs, benchmark)
    lined = found.groupBy("doc_id", "mark", "item_id", "n_items", "n", "size", "shift").agg(
        F.collect_set(F.struct("place", "slots")).alias("windows"))
    pair = lambda x: F.struct(x["item"].alias("item"), x["doc"].alias("doc"))
    every = F.array_distinct(F.flatten(F.transform("windows", lambda x: x["slots"])))
    lined = pinned(lined, "doc_id", "mark", "item_id", "n_items", "n", "size", "windows", all=every,
                   pairs=F.array_distinct(F.transform(every, pair)))
    side = lambda s, k: F.size(F.array_distinct(F.transform(s, lambda x: x[k])))
    consistent = (side(F.col("pairs"), "item") == F.size("pairs")) & (side(F.col("pairs"), "doc") == F.size("pairs"))
    places = lambda test: F.size(F.array_distinct(F.transform(F.filter("all", test), lambda x: x["place"])))
    most = F.filter("pairs", lambda p: let(
        places(lambda x: (x["item"] == p["item"]) & (x["doc"] == p["doc"])),
        lambda own: (2 * own > places(lambda x: x["item"] == p["item"])) & (2 * own > places(lambda x: x["doc"] == p["doc"]))))
    lined = pinned(lined, "doc_id", "mark", "item_id", "n_items", "n", "size", "windows",
                   right=F.when(consistent, F.col("pairs")).otherwise(most))
    good = F.filter("windows", lambda x: F.forall(x["slots"], lambda y: y["item"] == y["doc"])
                    | F.forall(x["slots"], lambda y: F.array_contains("right", pair(y))))
    kept = pinned(lined, "doc_id", "mark", "item_id", "n_items", "n", "size", windows=good).where(F.size("windows") > 0).groupBy(
        "doc_id", "mark", "item_id", "n_items", "n", "size").agg(F.flatten(F.collect_list("windows")).alias("windows"))
    kept = pinned(kept, "doc_id", "mark", "item_id", "n_items", "n", "size",
                  places=F.array_sort(F.array_distinct(F.transform("windows", lambda x: x["place"]))),
                  slots=F.array_distinct(F.transform(F.flatten(F.transform("windows", lambda x: x["slots"])), pair)))
    covered = F.aggregate(F.transform("places", lambda p, i: F.when(i == 0, F.col("size")).otherwise(
        F.least("size", p - F.get("places", i - 1)))), F.lit(0), lambda a, x: a + x)
    need = F.least(F.lit(COVER_WORDS), F.ceil(F.col("n") * COVER_SHARE))
    changed = F.size(F.filter("slots", lambda x: x["item"] != x["doc"]))
    return kept.select(
        "doc_id", "mark", "item_id", "n_items", covered.alias("covered_words"), F.col("n").alias("item_words"),
        F.size("slots").alias("n_slots"), changed.alias("changed_slots"),
        F.when(changed == 0, "exact").otherwise("reparameterised").alias("leak"),
    ).where(F.col("covered_words") >= need)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, columns as given; each row is judged by its own text."""
    spark = docs.sparkSession
    gone = written(leaks(docs, benchmark).select(
        F.struct("doc_id", "mark").alias("row")).distinct(), scratch_path(spark, "leaks"))
    name = "row"
    while name in docs.columns:
        name += "_"
    marked = docs.withColumn(name, F.struct("doc_id", F.xxhash64("text").alias("mark")))
    return without(marked, name, gone).select(*(F.col(f"`{c}`") for c in docs.columns))
