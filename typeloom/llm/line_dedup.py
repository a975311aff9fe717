"""Line deduplication by a deletion-neighbourhood join.

A line occurrence is dropped if the same line, or one within one word of it (a word put
in, left out or replaced), occurs earlier: in a smaller doc_id, or further up in the same
document. The earliest stays. Lines end at \\n and words at single blanks; lines of less
than MIN_WORDS words are compared for equality only (one word would be most of them), and
blank lines always stay.

1. Distinct lines, keyed by a 128-bit hash, with their earliest occurrence: a partial
   aggregation before the only shuffle of all lines, as hashes without text.
2. A lossless filter: lines within one word of each other share the first or the last half
   of their words. Lines whose halves occur in no other line have no neighbour and need
   no variants.
3. The rest emit every variant with one word left out as a hashed key, with the place and
   the length for replacements and without them for insertions. Equal keys of one kind
   thus mean a distance of one at most.
4. For each key the earliest line of each role is aggregated (no pairs are made), joined
   back to the key's lines, and the pair's edit distance is verified on the words.

Null texts are null and have no lines. Rows that repeat a doc_id are told apart by their
text; wholly equal rows get equal results: a line is not dropped for an occurrence at the
same place of an equal row. Null doc_ids come last. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import cut, stash

MIN_WORDS = 8


def _hash(c: Column, seed: str) -> Column:
    return F.xxhash64(F.lit(seed), c)


def lines_of(docs: DataFrame) -> DataFrame:
    """doc (key of the row), at (struct that orders occurrences), line, h, g (its hash)."""
    rows = docs.select(F.col("doc_id"), F.col("text"), F.xxhash64("text").alias("th"))
    out = rows.select("doc_id", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "pos")
    return out.where(F.trim("line") != "").select("doc_id", "th", "pos", key.alias("at"), "line", _hash(F.col("line"), "h").alias("h"), _hash(F.col("line"), "g").alias("g"))


def n_words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def within_one_word(a: Column, b: Column) -> Column:
    """Whether two arrays of words are one edit apart at most: their common start and end cover the longer but one."""
    n, m = F.size(a), F.size(b)
    low, high = F.least(n, m), F.greatest(n, m)
    same = F.zip_with(F.slice(a, 1, low), F.slice(b, 1, low), lambda x, y: x == y)
    back = F.zip_with(F.slice(F.reverse(a), 1, low), F.slice(F.reverse(b), 1, low), lambda x, y: x == y)
    run = lambda eq: F.when(F.array_position(eq, False) == 0, low).otherwise(F.array_position(eq, False) - 1)
    return (high - low <= 1) & (run(same) + run(back) >= high - 1)


def variants(lines: DataFrame, min_words: int) -> DataFrame:
    """h, g, at, key and role ('r': a replacement's, 's': the line itself, 'd': with a word left out).

    A word is left out only where the line's neighbours can differ: behind the first half
    if only that is shared, before the last one if only that is. Lines of less than
    min_words words are no replacement of each other, so they give their own key only, and
    every candidate keeps the length rule before the earliest is taken.
    """
    half = F.floor((F.col("n") - 1) / 2).cast("int")
    low = F.when(F.col("last"), F.lit(1)).otherwise(half + 1)
    high = F.when(F.col("first"), F.col("n")).otherwise(F.col("n") - half)
    cell = lines.select("h", "g", "at", "line", "n", F.explode(F.concat(F.array(F.lit(0)), F.sequence(low, high))).alias("i"))
    cell = cell.where((F.col("i") == 0) | (F.col("n") >= min_words))
    rest = F.expr("concat_ws(' ', if(i > 1, substring_index(line, ' ', i - 1), null), if(i < n, substring_index(line, ' ', i - n), null))")
    cell = cell.select("h", "g", "at", "i", "n", F.when(F.col("i") == 0, F.col("line")).otherwise(rest).alias("v"))
    own = F.struct(F.lit("s").alias("role"), _hash(F.col("v"), "i").alias("key"))
    less = F.struct(F.lit("d").alias("role"), _hash(F.col("v"), "i").alias("key"))
    swap = F.struct(F.lit("r").alias("role"), F.xxhash64(F.lit("r"), "v", "i", "n").alias("key"))
    kinds = F.when(F.col("i") == 0, F.array(own)).otherwise(F.array(less, swap))
    return cell.select("h", "g", "at", F.explode(kinds).alias("k")).select("h", "g", "at", "k.role", "k.key")


def _halves(lines: DataFrame, min_words: int) -> DataFrame:
    """h, g, first, half: the first and last halves of the words of each line that may have a neighbour."""
    rows = lines.select("h", "g", n_words(F.col("line")).cast("int").alias("n"), "line").where(F.col("n") >= min_words - 1)
    keys = []
    for o in (0, 1):
        m = F.expr(f"int(floor((n - {o}) / 2))")
        for first, sign in ((True, 1), (False, -1)):
            part = F.expr(f"substring_index(line, ' ', {sign} * int(floor((n - {o}) / 2)))")
            keys.append(F.struct(F.lit(first).alias("first"), F.xxhash64(F.lit(first), m, part).alias("half")))
    return rows.select("h", "g", F.explode(F.array_distinct(F.array(*keys))).alias("x")).select("h", "g", "x.first", "x.half")


def _near(lines: DataFrame, min_words: int) -> DataFrame:
    """h, g of the lines that share a half with another line, and which half."""
    half = _halves(lines, min_words)
    shared = half.groupBy("half").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo != hi").select("half")
    return half.join(shared, "half").groupBy("h", "g").agg(F.max("first").alias("first"), F.max(~F.col("first")).alias("last"))


def _twins(texts: DataFrame, min_words: int) -> DataFrame:
    """h, g of each line that an earlier one is within a word of."""
    found = variants(texts, min_words)
    crowded = found.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    found = cut(found.join(crowded, "key"))
    who = F.struct("at", "h", "g")
    best = found.groupBy("key").agg(*(F.min(F.when(F.col("role") == r, who)).alias(f"_{r}") for r in "rsd"))
    twin = F.when(F.col("role") == "r", F.col("_r")).when(F.col("role") == "s", F.col("_d")).otherwise(F.col("_s"))
    pairs = found.join(best, "key").withColumn("e", twin).where(F.col("e.at") < F.col("at")).groupBy("h", "g").agg(F.min("e").alias("e"))
    # Verify on the words.
    words = texts.select("h", "g", F.split("line", " ").alias("w"), "n")
    known = pairs.select("h", "g", F.col("e.h").alias("h2"), F.col("e.g").alias("g2")).join(words, ["h", "g"])
    other = words.select(F.col("h").alias("h2"), F.col("g").alias("g2"), F.col("w").alias("w2"), F.col("n").alias("n2"))
    close = known.join(other, ["h2", "g2"]).where(within_one_word(F.col("w"), F.col("w2")) & (F.greatest("n", "n2") >= min_words))
    return close.select("h", "g", F.lit(True).alias("fuzzy"))


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th, pos of each line occurrence that goes, and whether its earlier twin is exact."""
    lines = lines_of(docs)
    n = n_words(F.col("line")).cast("int").alias("n")
    short = lines.select("h", "g", "at", n)
    distinct, forget = stash(short.groupBy("h", "g").agg(F.min("at").alias("at"), F.count("*").alias("times"), F.min("n").alias("n")))
    near = cut(_near(lines, min_words))
    place = distinct.join(near, ["h", "g"]).select("h", "g", "n", "first", "last", F.col("at").alias("_at"))
    found = lines.select("h", "g", "at", "line").join(place, ["h", "g"]).where(F.col("at") == F.col("_at"))
    texts = cut(found.select("h", "g", "at", "n", "first", "last", "line").dropDuplicates(["h", "g"]))
    fuzzy = cut(_twins(texts, min_words))
    marks = distinct.join(fuzzy, ["h", "g"], "left").where((F.col("times") > 1) | F.col("fuzzy")).select("h", "g", F.col("at").alias("_at"), "fuzzy")
    spots = lines.select("doc_id", "th", "pos", "at", "h", "g").join(marks, ["h", "g"])
    later = F.col("at") > F.col("_at")
    out = cut(spots.where(later | F.col("fuzzy")).select("doc_id", "th", "pos", later.alias("exact")))
    forget()
    return out


def _applied(docs: DataFrame, min_words: int) -> DataFrame:
    """row (the docs' row as a struct), new_text, n_lines, n_dropped, n_near of each row."""
    gone = dropped_lines(docs.select("doc_id", "text"), min_words).groupBy("doc_id", "th").agg(F.collect_set("pos").alias("gone"), F.count_if(~F.col("exact")).alias("near"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own_id"), F.col("text").alias("own_text"), F.xxhash64("text").alias("own_th"))
    both = rows.join(gone, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_th") == F.col("th")), "left")
    cut_up = both.select("row", "own_text", "gone", "near", F.split("own_text", "\n", -1).alias("parts"))
    # What stands between one dropped line and the next, so that the cost follows the lines. Columns of their own, so that none is made twice.
    placed = cut_up.withColumn("ends", F.concat(F.array(F.lit(-1)), F.sort_array("gone"), F.array(F.size("parts"))))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("gone")), lambda i: F.slice(F.col("parts"), F.get(F.col("ends"), i) + 2, F.get(F.col("ends"), i + 1) - F.get(F.col("ends"), i) - 1)))
    text = F.when(F.col("gone").isNull(), F.col("own_text")).otherwise(F.array_join(kept, "\n"))
    return placed.select(
        "row", text.alias("new_text"), F.coalesce(F.size("parts"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("near", F.lit(0)).alias("n_near"),
    )


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text replaced by the kept lines, and n_lines, n_dropped, n_near (dropped without an equal twin).

    Columns of docs that have one of these three names give way.
    """
    own = ("n_lines", "n_dropped", "n_near")
    column = lambda c: F.col("new_text") if c.lower() == "text" else F.col("row").getField(c)
    return _applied(docs, min_words).select(*(column(c).alias(c) for c in docs.columns if c.lower() not in own), *own)


def thin(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with their kept lines as text (n_chars follows, if there is one), without the documents of which no text is left."""
    out = _applied(docs, min_words).where((F.col("n_dropped") == 0) | (F.trim("new_text") != ""))

    def column(c: str) -> Column:
        if c.lower() == "text":
            return F.col("new_text")
        if c.lower() == "n_chars":
            return F.when(F.col("n_dropped") > 0, F.length("new_text")).otherwise(F.col("row").getField(c)).cast(dict(docs.dtypes)[c])
        return F.col("row").getField(c)

    return out.select(*(column(c).alias(c) for c in docs.columns))
