"""Fuzzy line dedup by MinHash, in built-in functions only.

Lines are the parts of a text between newlines; all with a character other than white space are compared, blank ones
stay. Two lines are near copies where the Jaccard similarity of their sets of five-character shingles is 0.8 or more (a
line of fewer characters is one shingle).

Signature. Shingles of WIDTH characters are ordered by hash, those that start with a space before all others, and the
first MINIMA of this order are a line's signature: a bottom-k MinHash whose order favours one shingle in six, so that
few need hashing. Lines with fewer than FEW such shingles go on with the others; signatures of fewer than MINIMA
have marks at both ends, so that short ones meet by partial runs. Each RUN neighbours of the signature are a band.
Lines of at most SHORT characters have a second signature, of five-character shingles. On lines with random edits down
to a similarity of 0.8 the bands find 0.97 of the pairs, of closer ones more (measured; a test repeats it on a small scale).

Verification. Equal lines are one class from the start, so copies are never paired. Two lines of a band are compared
unless they are known to be of one component. First the lines of each band meet a central one, then, in bands that are
not of one component yet, CENTRAL - 1 further ones that no earlier one has joined; then each two lines of different
components that are left in a band meet. In bands with more than BLOCK lines left, only those meet that can be similar at
all: their shingles are ordered, rare ones first, and each two lines of different components that share one of the first
n - ceil(0.8 n) + 1 meet, so no pair that shares a band is lost. Of lines that meet, a sketch (of 64 * WORDS classes of
hashes, whether a line has an odd number of shingles in it) tells at least how many shingles are in one line alone; where
these are too many for the similarity, and only there, the pair is done. All others are compared by their whole shingle
sets. Links are closed by distributed union-find; a component keeps its first line by doc_id and line number.

All joins are plain ones on hashed keys, whatever the number of rows; where one side is much smaller, it alone is hashed
and the wide one not sorted. A sketch is of one line and does not grow or saturate with the data.
Shuffled once each: a row of keys for each line, the bands, and the texts of lines twice (for comparison and removal).

Defined results: a null text stays null and an empty one empty; a null doc_id sorts first; rows that repeat both doc_id
and text count as one document, and each of them loses the same lines; of equal lines at one place the order is that of
the row's hash; the order of kept lines and all other columns stay as they are, whatever their names; a document that
loses every line has an empty text. Very long lines are hashed in segments. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, is_empty, saved, swept
from .components import connected

SHINGLE, PERCENT = 5, 80
WIDTH, MINIMA, RUN = 9, 12, 3
#: Lines with fewer shingles that start with a space are filled up with others.
FEW = 8
#: Lines that also have a signature of narrow shingles, of NARROW minima.
SHORT, NARROW = 32, 8
#: Central lines that the lines of a band meet one after the other.
CENTRAL = 4
#: Lines left in a band of which each two meet; those of larger bands meet by rare shingles.
BLOCK = 4096
#: 64-bit words of a line's sketch.
WORDS = 16
#: Characters of a line that are hashed in one piece.
SEGMENT = 1 << 16


def _once(value: Column, use) -> Column:
    """use(value) with the value computed once, not for each element of an array inside."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hashes(line: Column, pattern: str) -> Column:
    """Distinct hashes of the shingles that the pattern captures at each place."""
    found = F.regexp_extract_all(line, F.lit(f"(?s)(?=({pattern}))"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.xxhash64(x)))


def _least(line: Column, pattern: str, width: int, most: int) -> Column:
    """The smallest hashes of a line's shingles, in order; a long line gives them by segments."""
    short = F.slice(F.sort_array(_hashes(line, pattern)), 1, most)
    starts = F.sequence(F.lit(1), F.length(line), F.lit(SEGMENT))
    pieces = F.flatten(F.transform(starts, lambda i: F.slice(F.sort_array(_hashes(F.substring(line, i, F.lit(SEGMENT + width - 1)), pattern)), 1, most)))
    return F.when(F.length(line) <= SEGMENT, short).otherwise(F.slice(F.sort_array(F.array_distinct(pieces)), 1, most))


def _runs(minima: Column, most: int, tag: int) -> Column:
    """Band keys of a signature."""
    ends = lambda mark: F.array(*[F.lit(mark).cast("long")] * (RUN - 1))
    padded = lambda m: F.when(F.size(m) < most, F.concat(ends(1), m, ends(2))).otherwise(m)
    run = lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - RUN), lambda i: F.xxhash64(F.lit(tag), *(F.get(p, i + k) for k in range(RUN))))
    return _once(minima, lambda m: _once(padded(m), run))


def bands(line: Column) -> Column:
    """Distinct band keys of a line."""
    spaced, other = f" .{{{WIDTH - 1}}}", f"[^ ].{{{WIDTH - 1}}}"
    first = _least(line, spaced, WIDTH, MINIMA)
    whole = F.when(F.length(line) < WIDTH, F.array(F.xxhash64(line))).otherwise(F.array().cast("array<long>"))
    filled = _once(first, lambda m: F.when(F.size(m) >= FEW, m).otherwise(F.slice(F.concat(m, _least(line, other, WIDTH, MINIMA), whole), 1, MINIMA)))
    narrow = F.when(F.length(line) < SHINGLE, F.array(F.xxhash64(line))).otherwise(_least(line, f".{{{SHINGLE}}}", SHINGLE, NARROW))
    both = F.when(F.length(line) <= SHORT, F.concat(_runs(filled, MINIMA, 0), _runs(narrow, NARROW, 1))).otherwise(_runs(filled, MINIMA, 0))
    return F.array_distinct(both)


def shingles(line: Column) -> Column:
    """Distinct hashes of a line's five-character shingles."""
    # Four bytes for every character, so that a shingle is cut out without a search for its place.
    at = lambda b: F.sequence(F.lit(1), F.greatest(F.octet_length(b) - (4 * SHINGLE - 1), F.lit(1)), F.lit(4))
    cut = _once(F.encode(line, "UTF-32"), lambda b: F.transform(at(b), lambda i: F.xxhash64(F.substring(b, i, F.lit(4 * SHINGLE)))))
    return F.array_distinct(cut)


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line_no, line) of every line that is compared."""
    row = F.xxhash64("doc_id", "text").alias("row")
    return docs.where("text IS NOT NULL").select("doc_id", row, F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.col("line").rlike("\\S"))


def _sketches(texts: DataFrame) -> DataFrame:
    """(h, n, w0, w1, ...) of lines: the number of shingles, and a bit for each class of hashes that is set if an odd number of them is in it."""
    rows = texts.select("h", F.explode(shingles(F.col("line"))).alias("s"))
    bit = "shiftleft(1L, cast(s & 63 AS int))"
    words = [F.expr(f"bit_xor(IF((shiftright(s, 6) & {WORDS - 1}) = {j}, {bit}, 0L))").alias(f"w{j}") for j in range(WORDS)]
    return rows.groupBy("h").agg(F.count("*").alias("n"), *words)


def _side(rows: DataFrame, k: str, *shared: str) -> DataFrame:
    """Rows with a sketch as one side (a or b) of pairs; shared columns keep their names."""
    own = [c for c in rows.columns if c not in ("h", *shared)]
    return rows.select(*shared, F.col("h").alias(k), *(F.col(c).alias(f"{c[0]}{k}{c[1:]}") for c in own))


def _may_link(percent: int) -> str:
    """Whether two sketches leave it open that the lines are similar enough: a class that differs has a shingle of one line alone."""
    alone = " + ".join(f"bit_count(wa{j} ^ wb{j})" for j in range(WORDS))
    return f"{100 + percent} * ({alone}) <= {100 - percent} * (na + nb)"


def _near(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of lines that their sketches do not tell apart."""
    both = pairs.join(_side(sketches, "a").hint("merge"), "a").join(_side(sketches, "b").hint("merge"), "b")
    return both.where(_may_link(percent)).select("a", "b")


def _linked(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of lines whose shingle sets are similar enough; texts has (h, line)."""
    side = lambda k: texts.select(F.col("h").alias(k), F.col("line").alias(f"t{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    sets = both.select("a", "b", shingles(F.col("ta")).alias("x"), shingles(F.col("tb")).alias("y"))
    sized = sets.select("a", "b", F.size(F.array_intersect("x", "y")).alias("c"), (F.size("x") + F.size("y")).alias("n"))
    return sized.where(F.expr(f"100 * c >= {percent} * (n - c)")).select("a", "b")


def _left_over(rest: DataFrame, texts: DataFrame, sketches: DataFrame, of: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components among the lines (h) by rare shingles; all pairs that are similar enough are among them."""
    of = of.select(F.col("id").alias("h"), F.col("component_id").alias("c"))
    sets = rest.join(texts, "h").select("h", shingles(F.col("line")).alias("x"))
    rows = sets.select("h", F.size("x").alias("n"), F.explode("x").alias("s"))
    often = rows.groupBy("s").agg(F.count("*").alias("f"))
    # A shingle of one line alone still takes its place among the first.
    ranked = rows.join(often.hint("merge"), "s").groupBy("h", "n").agg(F.array_sort(F.collect_list(F.struct("f", "s"))).alias("x"))
    first = ranked.select("h", "n", F.explode(F.expr(f"slice(x, 1, cast(n - ({percent} * n + 99) div 100 + 1 as int))")).alias("x")).where("x.f > 1")
    first = first.select("h", "n", F.col("x.s").alias("s")).join(of.hint("merge"), "h", "left").withColumn("c", F.coalesce("c", "h"))
    open_ = first.groupBy("s").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("s")
    # Lines come with their sketches, so that only pairs that these leave open are made.
    first = first.join(open_.hint("merge"), "s").select("s", "h", "c").join(sketches.hint("merge"), "h")
    sized = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    met = _side(first, "a", "s").hint("merge").join(_side(first, "b", "s"), "s").where(f"a < b AND ca <> cb AND {sized} AND {_may_link(percent)}")
    return met.select("a", "b").distinct()


def _components(keyed: DataFrame, texts: DataFrame, percent: int) -> tuple[DataFrame, str]:
    """(id, component_id) of linked lines, from (band, h, m) of the lines in bands of m lines."""
    spark = keyed.sparkSession
    sketches, sketches_at = saved(_sketches(texts), "line-sketches")
    of = keyed.select(F.col("h").alias("id"), F.col("h").alias("component_id")).limit(0)
    of, of_at = saved(of, "line-components")

    def joined(met: DataFrame) -> None:
        """Compare pairs that their sketches do not tell apart, and close the links."""
        nonlocal of, of_at
        pairs, pairs_at = saved(met, "line-pairs")
        links, links_at = saved(_linked(pairs, texts, percent), "line-links")
        old_at = of_at
        of, of_at = saved(connected(links.union(of.select(F.col("id").alias("a"), F.col("component_id").alias("b")))), "line-components")
        dropped(spark, pairs_at, links_at, old_at)

    rows, rows_at = keyed.select("band", "h", F.col("h").alias("c"), F.lit(False).alias("joined")), None
    for _ in range(CENTRAL):
        # The least of the lines that no central one has joined.
        central = rows.groupBy("band").agg(F.min(F.struct("joined", "h", "c")).alias("o")).select("band", F.col("o.h").alias("o"), F.col("o.c").alias("co"))
        led, led_at = saved(rows.join(central.hint("merge"), "band"), "band-rows")
        dropped(spark, *([rows_at] if rows_at else []))
        met = led.where("c <> co").select(F.least("h", "o").alias("a"), F.greatest("h", "o").alias("b")).distinct()
        joined(_near(met, sketches, percent))
        now = led.select("band", "h", "joined", "o").join(of.select(F.col("id").alias("h"), F.col("component_id").alias("c")).hint("merge"), "h", "left").withColumn("c", F.coalesce("c", "h"))
        # A central line has met all others of its band and is done.
        left = F.when(F.col("h") != F.col("o"), F.col("c"))
        open_ = now.groupBy("band").agg(F.min(left).alias("c0"), F.max(left).alias("c1"), F.count(left).alias("m"), F.max(F.when(F.col("h") == F.col("o"), F.col("c"))).alias("co"))
        rest = now.where("h <> o").join(open_.where("c0 <> c1").select("band", "m", "co").hint("merge"), "band")
        rows, rows_at = saved(rest.select("band", "h", "c", (F.col("joined") | (F.col("c") == F.col("co"))).alias("joined"), "m"), "band-rows")
        dropped(spark, led_at)
        swept(spark)
    known = rows.where(f"m <= {BLOCK}").select("band", "h", "c").join(sketches.hint("merge"), "h")
    met = _side(known, "a", "band").hint("merge").join(_side(known, "b", "band"), "band").where(f"a < b AND ca <> cb AND {_may_link(percent)}")
    joined(met.select("a", "b").distinct())
    over, over_at = saved(rows.where(f"m > {BLOCK}").select("h").distinct(), "band-rest")
    if not is_empty(over):
        joined(_left_over(over, texts, sketches, of, percent))
    dropped(spark, rows_at, sketches_at, over_at)
    swept(spark)
    return of, of_at


def removals(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, list[str]]:
    """(doc_id, row, line_no) of every line that a component keeps elsewhere, from columns doc_id and text."""
    spark = docs.sparkSession
    place, check = F.struct("doc_id", "row", "line_no"), F.struct("crc", "n")
    lines = _lines(docs).select("doc_id", "row", "line_no", F.xxhash64("line").alias("h"), F.crc32(F.encode("line", "UTF-8")).alias("crc"), F.length("line").alias("n"), bands(F.col("line")).alias("bands"))
    classes = lines.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.min(check).alias("c0"), F.max(check).alias("c1"), F.first("bands").alias("bands"))
    # Two lines with one 64-bit id are told by length and checksum; such lines all stay.
    classes, classes_at = saved(classes.where("c0 = c1").select("h", "first", F.expr("first <> last").alias("copied"), "bands"), "line-classes")
    # Every distinct line comes to its bands once; bands of one line alone go no further.
    dealt = classes.select("h", F.explode("bands").alias("band")).repartition("band")
    ends = dealt.groupBy("band").agg(F.count("*").alias("m")).where("m > 1")
    keyed, keyed_at = saved(dealt.join(ends.hint("shuffle_hash"), "band").select("band", "h", "m"), "bands")
    swept(spark)
    asked = classes.select("h", "first").join(keyed.select("h").distinct(), "h")
    at = asked.select("h", F.col("first.doc_id").alias("_id"), F.col("first.row").alias("_row"), F.col("first.line_no").alias("_no"))
    texts = _lines(docs).join(at.hint("shuffle_hash"), (F.col("row") == F.col("_row")) & (F.col("line_no") == F.col("_no")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    # Rows that repeat a document have one place twice.
    texts, texts_at = saved(texts.groupBy("h").agg(F.min("line").alias("line")), "line-texts")
    swept(spark)
    of, of_at = _components(keyed, texts, percent)
    dropped(spark, keyed_at, texts_at)
    # Lines of which there is more than one, by class or by component.
    many = classes.select("h", "first", "copied").join(of.withColumnRenamed("id", "h"), "h", "left").where("copied OR component_id IS NOT NULL")
    many, many_at = saved(many.select("h", "first", F.coalesce("component_id", "h").alias("component_id")), "lines-many")
    winners = many.groupBy("component_id").agg(F.min("first").alias("kept"))
    ruled, ruled_at = saved(many.join(winners, "component_id").select("h", "kept"), "line-winners")
    gone = _lines(docs).select("doc_id", "row", "line_no", F.xxhash64("line").alias("h")).join(ruled, "h").where(place != F.col("kept"))
    gone, gone_at = saved(gone.select("doc_id", "row", "line_no"), "lines-gone")
    dropped(spark, classes_at, of_at, many_at, ruled_at)
    return gone, [gone_at]


def dedup(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text", removed: str | None = None) -> DataFrame:
    """docs without the lines that another line stands for; ``removed`` names a column for their number."""
    own = docs.columns
    plain = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    gone, _ = removals(plain, percent)
    lost = gone.groupBy("doc_id", "row").agg(F.collect_set("line_no").alias("lost"))
    lost = lost.select(F.col("doc_id").alias("_confluo_id"), F.col("row").alias("_confluo_row"), F.col("lost").alias("_confluo_lost"))
    wide = docs.withColumn("_confluo_key", F.xxhash64(docs[doc_id], docs[text].cast("string")))
    joined = wide.join(lost, (F.col("_confluo_key") == F.col("_confluo_row")) & wide[doc_id].eqNullSafe(F.col("_confluo_id")), "left")
    numbers = F.array_except(F.sequence(F.lit(0), F.size("_confluo_parts") - 1), F.col("_confluo_lost"))
    rest = F.array_join(F.transform(numbers, lambda i: F.get(F.col("_confluo_parts"), i)), "\n")
    parts = joined.withColumn("_confluo_parts", F.when(F.col("_confluo_lost").isNotNull(), F.split(F.col(f"`{text}`").cast("string"), "\n")))
    new = F.when(F.col("_confluo_lost").isNull(), F.col(f"`{text}`")).otherwise(rest)
    n = F.when(F.col("_confluo_lost").isNull(), 0).otherwise(F.size("_confluo_lost")).cast("long")
    return parts.select(*(new.alias(c) if c == text else F.col(f"`{c}`") for c in own), *([n.alias(removed)] if removed else []))
