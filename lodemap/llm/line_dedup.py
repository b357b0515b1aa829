"""Line dedup within one word edit, by a deletion-neighbourhood join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hinted, rest, written

#: The edit bound of a line: one word in as many, and one at most. So shorter lines are repeated only when they are equal.
LEAST_WORDS = 8
#: 40 bits of a word's hash, so that sums over a line stay within 64 bits.
_MASK = (1 << 40) - 1
_SPACE = "[\\x20\\x09-\\x0D]+"


def _document(key: str, text: str) -> Column:
    """What tells documents apart and orders them: the key, then a hash of the text."""
    return F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("body"))


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each line with a word: its place ``at`` (document, number), its words joined by single spaces, a 128-bit id
    of these, and their number ``n``. White space is rewritten only in lines that have other than single spaces."""
    rows = docs.select(_document(key, text).alias("__doc"), F.split(text, "\n", -1).alias("__lines"))
    lines = rows.select("__doc", F.posexplode("__lines").alias("__no", "__line"))
    odd = F.lit(False)
    for mark in ("  ", "\t", "\r", "\x0b", "\x0c"):
        odd = odd | F.contains("__line", F.lit(mark))
    even = F.when(odd, F.regexp_replace("__line", _SPACE, " ")).otherwise(F.col("__line"))
    at = F.struct(F.col("__doc").alias("doc"), F.col("__no").alias("no")).alias("at")
    plain = lines.select(at, F.trim(even).alias("line")).where("line <> ''")
    spaces = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit("")))
    return plain.select(
        "at", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), (spaces + 1).alias("n")
    )


def _half_keys() -> Column:
    """Hashes of the beginnings and ends that two lines within one edit share one of.

    Lines of n and n' words within one edit agree in max(n, n') - 1 words from the two ends together, so in the first or in
    the last max(n, n') div 2 words. A line has those lengths for partners of as many words and of one more: first and last
    of n div 2 words, then, if n is odd, of one word more.
    """
    ends = "xxhash64('first', {k}, substring_index(line, ' ', {k})), xxhash64('last', {k}, substring_index(line, ' ', -({k})))"
    less, more = ends.format(k="n div 2"), ends.format(k="n div 2 + 1")
    ends = F.expr(f"if(n % 2 = 0, array({less}), array({less}, {more}))".replace("n div 2", "cast(n div 2 as int)"))
    return ends


def _shared_mask() -> Column:
    """Which of a line's halves another line has: 1 and 2 for the shorter beginning and end, 4 and 8 for the longer ones."""
    bits = (f"if(coalesce(array_contains(shared, get(halves, {i})), false), {1 << i}, 0)" for i in range(4))
    return F.expr(" + ".join(bits))


def _edit_places() -> Column:
    """The numbers of the words where an edit may be: behind a shared beginning, or before a shared end."""
    return F.expr(
        "filter(sequence(0, n - 1), i -> i >= case when mask & 1 = 1 then n div 2 when mask & 4 = 4 then n div 2 + 1 else n end"
        " or i < case when mask & 2 = 2 then n - n div 2 when mask & 8 = 8 then n - n div 2 - 1 else 0 end)"
    )


def within_one_edit(a: str, b: str) -> Column:
    """Whether two word arrays are within one inserted, deleted or replaced word: equal words at both ends leave one at most."""
    same = f"size({a}) = size({b}) and aggregate(zip_with({a}, {b}, (x, y) -> if(x <=> y, 0, 1)), 0, (s, d) -> s + d) <= 1"
    first = "coalesce(array_position(zip_with({a}, slice({b}, 1, size({a})), (x, y) -> x <=> y), false), size({a}) + 1)"
    longer = "(size({b}) = size({a}) + 1 and slice({a}, cast(nullif0 as int), size({a})) <=> slice({b}, cast(nullif0 + 1 as int), size({b})))"

    def one_more(short: str, long: str) -> str:
        pos = first.format(a=short, b=long)
        at = f"if({pos} = 0, size({short}) + 1, {pos})"
        return longer.format(a=short, b=long).replace("nullif0", at)

    return F.expr(f"({same}) or {one_more(a, b)} or {one_more(b, a)}")


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """The places (``at``) of lines that an earlier line repeats: equal words, or one word inserted, deleted or replaced.

    Earlier is by key, then hash of the text, then line number; a null key comes first. The test looks at all lines,
    removed or not, so the result doesn't depend on any order of work. Every copy counts once (equal lines are gathered
    before anything is joined), so a line that a third of all rows hold is one row in the joins.

    The deletion neighbourhood of a line has two kinds of keys for each word: ``but``, the words in their places without the
    one at place i, which two lines share that differ in that word alone; and ``less``, the bag of the other words, which is
    the bag of a line that lacks the word. Only lines that share a half with another line (``_half_keys``) can have a
    neighbour, and only at places outside it, so only those are emitted. Bags and places are hashed by the exclusive or and
    the sum of the words' hashes: a variant costs the same however long its line is. What shares a key is verified.
    """
    lines = lines_of(docs, key, text)
    half = F.when(F.col("n") >= least_words, _half_keys())
    table = written(lines.select("at", "h1", "h2", "n", half.alias("halves")), "lines")  # no text: places and hashes
    distinct = table.groupBy("h1", "h2").agg(
        F.min("at").alias("first"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min("halves").alias("halves")
    )
    distinct = written(distinct, "distinct-lines")
    again = distinct.where("copies > 1").select("h1", "h2", "first")
    copies = table.select("at", "h1", "h2").join(again, ["h1", "h2"]).where(F.col("at") != F.col("first")).select("at")

    ends = distinct.where("halves is not null").select("h1", F.explode("halves").alias("half"))
    shared = ends.groupBy("half").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("half")
    shared = ends.join(shared, "half").groupBy("h1").agg(F.collect_set("half").alias("shared"))  # four at most
    likely = distinct.join(shared, "h1").select("h1", F.col("first").alias("place"), "n", "halves", "shared")
    # ids in the order of the places
    likely = written(likely.orderBy("place").withColumn("id", F.monotonically_increasing_id()), "likely-lines")
    chosen = likely.select("id", F.col("h1").alias("own"), "place", _shared_mask().alias("mask"))
    chosen = hinted(chosen, "120 + coalesce(octet_length(cast(place.doc.key as string)), 0)")
    same = (F.col("h1") == F.col("own")) & (F.col("at") == F.col("place"))
    read = lines.select("at", "h1", "n", "line").join(chosen, same)
    words = read.select("id", _edit_places().alias("places"), "n", F.split("line", " ").alias("words"))
    words = words.withColumn("bag", F.expr("transform(words, w -> xxhash64(w))"))
    words = words.withColumn("placed", F.expr("transform(words, (w, i) -> xxhash64(w, i))"))
    for name in ("bag", "placed"):
        words = words.withColumn(f"{name}_x", F.expr(f"aggregate({name}, 0L, (s, h) -> s ^ h)"))
        words = words.withColumn(f"{name}_s", F.expr(f"aggregate({name}, 0L, (s, h) -> s + (h & {_MASK}L))"))
    words = written(words, "likely-words")
    if words.count() > likely.count():  # rows that repeat key and text
        words = written(words.dropDuplicates(["id"]), "likely-words")

    but = f"transform(places, i -> xxhash64('but', n, i, placed_x ^ placed[i], placed_s - (placed[i] & {_MASK}L)))"
    less = f"transform(places, i -> xxhash64('bag', n - 1, bag_x ^ bag[i], bag_s - (bag[i] & {_MASK}L)))"
    whole = words.select(F.expr("xxhash64('bag', n, bag_x, bag_s)").alias("key"), F.col("id").alias("short"))

    # replaced words: all lines of a key are within one edit of each other, so the earliest stands for them
    variants = words.select("id", F.explode(F.expr(but)).alias("key"))
    groups = variants.groupBy("key").agg(F.min("id").alias("other"), F.max("id").alias("id"), F.count("*").alias("c"))
    groups = written(groups.where("other < id"), "line-groups")
    # keys of two lines are pairs already; only the lines of larger groups are looked up again
    large = variants.join(hinted(groups.where("c > 2").select("key", "other"), "32"), "key").where("other < id")
    replaced = groups.where("c = 2").select("id", "other").unionByName(large.select("id", "other"))
    replaced = replaced.groupBy("id").agg(F.min("other").alias("other"))
    # inserted or deleted words: a whole line and the lines that lack one of their words to be it
    lacking = words.select(F.col("id").alias("long"), F.explode(F.expr(less)).alias("key"))
    pairs = lacking.join(hinted(whole, "48"), "key")
    pairs = pairs.select(F.greatest("short", "long").alias("id"), F.least("short", "long").alias("other"))
    pairs = pairs.unionByName(replaced).distinct()
    mine = words.select("id", F.col("words").alias("a"))
    theirs = words.select(F.col("id").alias("other"), F.col("words").alias("b"))
    near = pairs.join(mine, "id").join(theirs, "other").where(within_one_edit("a", "b")).select("id").distinct()
    return copies.unionByName(likely.join(near, "id").select(F.col("place").alias("at"))).distinct()


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents without their repeated lines: all columns, plus ``n_lines`` and ``n_removed``.

    A line goes if an earlier line (see ``repeated_lines``) has equal words, or, where both have ``least_words`` words or
    more, differs from it in one inserted, deleted or replaced word. Lines are cut at newlines and words at ASCII white
    space; lines without a word stay. A null text stays null with no lines; an empty one has one line and stays; documents
    whose lines all go stay with an empty text. Rows of equal key and text are one document and fare alike. An empty table
    gives no rows. Other columns pass through, but for ones named as the two that are added.
    """
    gone = repeated_lines(docs, key, text, least_words).groupBy(F.col("at.doc").alias("__doc"))
    gone = gone.agg(F.collect_set("at.no").alias("__gone"))  # as long as the document at most
    gone = gone.select(F.col("__doc.key").alias("__key"), F.col("__doc.body").alias("__body"), "__gone")
    gone = written(gone, "gone")
    rest(docs.sparkSession)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.xxhash64(text).alias("__hash"))
    same = F.col("__row")[key].eqNullSafe(F.col("__key")) & (F.col("__hash") == F.col("__body"))
    rows = rows.join(hinted(gone, "100 + octet_length(cast(__key as string)) + 8 * size(__gone)"), same, "left")
    cut = F.split(F.col("__row")[text], "\n", -1)
    left = F.array_join(F.filter(cut, lambda _, i: ~F.array_contains("__gone", i)), "\n")
    body = F.when(F.col("__gone").isNull(), F.col("__row")[text]).otherwise(left)
    own = [(body if c == text else F.col("__row")[c]).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return rows.select(
        *own,
        F.coalesce(F.size(cut), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
