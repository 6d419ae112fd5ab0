"""Line dedup across documents by a deletion-neighbourhood join, in DataFrame functions only.

Lines are the \\n-split parts of a text, trimmed of blanks for comparison; blank lines (nothing but WHITE)
are never compared and always stay. A line is removed if an earlier line, by (doc_id, hash of the text, line number), is
equal or, for lines of near characters and more (a parameter, NEAR unless given), at edit distance 1. Earlier lines count
whether they stay themselves or not.

Distinct lines come first, with their earliest place. A line is cut into four segments; one edit leaves three of them
alone, so only lines that share the other three with another distinct line go on. These emit their variants as hashed
keys: the shared segments, and the rest of the line less one character; the rest is cut and shared in the same way once
more before that, and again while it is longer than REST. Lines of SHORT characters at most emit theirs as a whole. Equal
variants at one position are lines that differ in that character; a variant that is a whole
line is one with a character less. Such groups are small by nature, and each line is only set against the earliest of its group, so no pairs within a group are made. The edit
distance of each pair found is verified.

Nulls and empty texts have no line to remove and stay as they are. Rows of one doc_id with different texts are documents
of their own, with equal texts one document, whose rows are all treated alike. Columns other
than doc_id and text are kept. An empty table gives an empty result. Long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.shared import BITS, BUCKET, placed, save

#: Least number of characters of a line that is compared by edit distance; shorter ones only by equality.
NEAR = 16
#: Lines of this many characters at most emit their variants as a whole; what is left of longer ones by cutting is cut
#: again while it has more than REST characters.
SHORT, REST = 16, 128
#: White space: blank, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"
SEGMENTS = 4


def blank(text: str) -> Column:
    """Whether a text has nothing but white space."""
    return F.ltrim(text, F.lit(WHITE)) == ""


def _lines(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    rows = rows.withColumn("line", F.trim("line")).where(~blank("line") & F.col("d").isNotNull())
    return rows.withColumn("h", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line"))


def segment(n: Column) -> Column:
    """Length of a segment for lines of n characters: a quarter, rounded down to three binary digits."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(n / SEGMENTS)) - 2)
    return F.greatest(F.floor(F.floor(n / SEGMENTS) / step) * step, F.lit(1)).cast("int")


def segments(rows: DataFrame, text: str, least: int, *above: str) -> DataFrame:
    """rows with s and t, the lengths of a segment of the text for its own length and (if another) for one character less,
    and key0 to key7: for each segment that may hold the edit, a hash of the others, from both ends of the text, and of
    the columns above; by s, then by t. Texts of less than least characters have no s and t.

    Every step has columns of its own, as an expression is worked out anew wherever it stands.
    """
    n, kept = F.col("n__"), rows.columns
    rows = rows.withColumn("n__", F.char_length(text))
    rows = rows.withColumn("s", F.when(n >= least, segment(n))).withColumn("t", F.when(n >= least, segment(n - 1)))
    rows = rows.withColumn("t", F.when(F.col("s") != F.col("t"), F.col("t")))
    keys = []
    for s in (F.col("s"), F.col("t")):
        front = [F.substring(text, 1 + s * j, s) for j in range(SEGMENTS - 1)]
        back = [F.substring(text, n - s * (SEGMENTS - 1 - j) + 1, s) for j in range(SEGMENTS - 1)]
        keys += [F.xxhash64(*above, F.lit(k), s, *front[:k], *back[k:]) for k in range(SEGMENTS)]
    return rows.select(*kept, "s", "t", *(key.alias(f"key{k}") for k, key in enumerate(keys)))


def each_key(rows: DataFrame, *columns: str) -> DataFrame:
    """columns, k (the segment left out), s, key of what segments() gives."""
    keys = F.array(*(F.struct(F.lit(k % SEGMENTS).alias("k"), F.col("st"[k // SEGMENTS]).alias("s"), F.col(f"key{k}").alias("key")) for k in range(2 * SEGMENTS)))
    return rows.select(*columns, F.explode(keys).alias("x")).select(*columns, "x.*").where("s IS NOT NULL")


def left_out(text: str) -> Column:
    """The segment k of the text, and what the other segments don't reach."""
    return F.substring(text, F.col("k") * F.col("s") + 1, F.char_length(text) - (SEGMENTS - 1) * F.col("s"))


def _maybe(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows whose h may be one of wanted: a bitmap of fixed size (256 rows of 4 kB) is broadcast; an exact join follows."""
    place = placed("h")
    bucket, bit = F.shiftright(place, 15), place.bitwiseAND(F.lit(BUCKET - 1).cast("long"))
    bits = wanted.select(bucket.alias("bucket"), bit.alias("p")).groupBy("bucket").agg(F.bitmap_construct_agg("p").alias("m"))
    assert BITS // BUCKET == 256
    found = rows.withColumn("bucket", bucket).join(F.broadcast(bits), "bucket")
    byte = F.conv(F.hex(F.substring("m", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return found.where(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), bit.bitwiseAND(F.lit(7).cast("long")).cast("int"))) != 0).drop("bucket", "m")


def cut(rows: DataFrame) -> DataFrame:
    """key, rest, place (d, th, i): the rests of rows cut into segments, each left out in turn."""
    return each_key(segments(rows, "rest", 0, "key").drop("key"), "rest", "d", "th", "i").select("key", left_out("rest").alias("rest"), "d", "th", "i")


def near_lines(docs: DataFrame, lines: DataFrame, distinct: DataFrame, least: int) -> DataFrame:
    """h, h2 of distinct lines that have an earlier line at edit distance 1, both of least characters or more."""
    keys = each_key(lines, "h")
    shared = save(keys.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("z")).where("a <> z").select(F.col("key").alias("h")))
    held = _maybe(keys.select(F.col("h").alias("own"), "k", "s", F.col("key").alias("h")), shared).join(shared, "h")
    held = held.select(F.col("own").alias("h"), "k", "s", F.col("h").alias("key")).distinct()
    near = save(held.join(distinct, "h").select("h", "h2", "first", "k", "s", "key"))
    one = near.select("h", "h2", "first")
    if least < SHORT:
        one = one.unionByName(distinct.where("small").select("h", "h2", "first"))
    one = one.select("h", "h2", "first.d", "first.th", "first.i").distinct()
    place = F.struct("d", "th", "i")
    texts = save(_maybe(_lines(docs), one).join(one, ["h", "h2", "d", "th", "i"]).select("h", "h2", "line", place.alias("first")).dropDuplicates(["h", "h2"]))
    # the key stands for what a line shares; the earliest place names the line
    rest = texts.join(near.select("h", "h2", "k", "s", "key"), ["h", "h2"]).select("key", left_out("line").alias("rest"), "first.*")
    finer = save(cut(rest))
    while True:  # a fourth is left each time
        again = finer.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("z")).where("a <> z").select("key")
        finer = save(finer.join(again, "key"))
        if finer.where(F.char_length("rest") > REST + 1).isEmpty():
            break
        # rests of REST + 1 characters may meet longer and shorter ones: they go both ways
        finer = save(finer.where(F.char_length("rest") <= REST + 1).unionByName(cut(finer.where(F.char_length("rest") > REST))))
    if least < SHORT:
        finer = finer.unionByName(texts.where(F.char_length("line").between(least, SHORT)).select(F.lit(0).cast("long").alias("key"), F.col("line").alias("rest"), "first.*"))
    variants = finer.withColumn("p", F.explode(F.sequence(F.lit(0), F.char_length("rest"))))
    less = F.when(F.col("p") == 0, F.col("rest")).otherwise(F.concat(F.substring("rest", F.lit(1), F.col("p") - 1), F.substring("rest", F.col("p") + 1, F.char_length("rest"))))
    variants = variants.select(F.xxhash64("key", less).alias("v"), "p", place.alias("own"))  # p 0: nothing deleted
    same, whole = Window.partitionBy("v", "p"), Window.partitionBy("v")
    own = F.col("own")
    replaced = F.when(F.col("p") > 0, F.min(own).over(same))
    longer = F.when(F.col("p") > 0, F.min(F.when(F.col("p") == 0, own)).over(whole))
    shorter = F.when(F.col("p") == 0, F.min(F.when(F.col("p") > 0, own)).over(whole))
    pairs = variants.select("own", F.array(replaced, longer, shorter).alias("to")).select("own", F.explode("to").alias("to")).where("to < own").distinct()
    other = texts.select(F.col("first").alias("to"), F.col("line").alias("earlier"))
    return pairs.join(texts.select("h", "h2", F.col("first").alias("own"), "line"), "own").join(other, "to").where(F.levenshtein("line", "earlier", 1) >= 0).select("h", "h2").distinct()


def removals(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """d (doc_id), th (hash of the text), removed: array of the numbers (from 0) of its lines that go; only documents that lose lines."""
    small = F.char_length("line").between(near, SHORT)
    lines = save(segments(_lines(docs).withColumn("small", small), "line", max(near, SHORT)).drop("line"))
    place = F.struct("d", "th", "i")
    distinct = save(lines.groupBy("h", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.first("small").alias("small")))
    close = near_lines(docs, lines, distinct, near).select("h", "h2", F.lit(None).cast(distinct.schema["first"].dataType).alias("first"))
    gone = save(distinct.where("first < last").select("h", "h2", "first").unionByName(close))  # first null: every one goes
    rows = _maybe(lines.select("d", "th", "i", "h", "h2"), gone).join(gone, ["h", "h2"]).where(F.col("first").isNull() | (F.col("first") < place))
    return rows.groupBy("d", "th").agg(F.collect_set("i").alias("removed"))


def free(df: DataFrame, name: str) -> str:
    """name, with underscores after it until no column of df has it; case doesn't tell columns apart."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def dedup(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """docs with text less its removed lines, and n_lines, n_removed (int), which take the place of columns of that name."""
    d, t, removed, flags = (free(docs, name) for name in ("d", "th", "removed", "flags"))
    gone = removals(docs, near).toDF(d, t, removed)
    flag = lambda x, gone: F.struct(x.alias("i"), F.lit(gone).alias("gone"))
    stay = F.array_except(F.sequence(F.lit(0), F.array_max(removed)), removed)
    marked = F.array_sort(F.concat(F.transform(stay, lambda x: flag(x, False)), F.transform(removed, lambda x: flag(x, True))))
    gone = gone.withColumn(flags, F.transform(marked, lambda x: x["gone"]))  # by line number, so that each line is looked up once
    out = docs.join(gone, (F.col("doc_id") == F.col(d)) & (F.xxhash64("text") == F.col(t)), "left")
    parts = F.split("text", "\n", -1)
    kept = F.filter(parts, lambda x, i: ~F.coalesce(F.get(flags, i), F.lit(False)))
    text = F.when(F.col(removed).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    others = [c for c in docs.columns if c.lower() not in ("text", "n_lines", "n_removed")]
    return out.select(*others, text.alias("text"), F.coalesce(F.size(parts), F.lit(0)).alias("n_lines"), F.coalesce(F.size(removed), F.lit(0)).alias("n_removed"))
