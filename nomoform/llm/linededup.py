"""Line dedup in DataFrame functions only: by content-defined chunks of lines, and by all passages of lines.

Chunks that do not overlap miss a quarter of the repeated lines: where a chunk
ends depends on lines outside a short passage. The chunks here start and end by
lines of their own and may overlap. Windows of two lines find the passages that
chunks leave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hash_bitmap, let, may_hold

#: The rolling hash of two neighbouring lines is (first * BASE + second) % MODULUS; its remainder by BOUNDARY decides.
BASE, MODULUS, BOUNDARY = 257, 1_000_003, 16
#: A chunk is hot if more than one in so many repeated chunks, and at least HOT_ROWS, are copies of it.
HOT_KEYS, HOT_ROWS = 1000, 1000
#: A chunk has at least this many lines with a word.
MIN_LINES = 2
#: A line with a word.
WORDED = r"[^\x20\x09-\x0D]"


#: What tells a unit from others.
_PLACE = ["doc_id", "t1", "t2", "no"]


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def chunks(text: Column) -> Column:
    """The content-defined chunks of a text: array of no, last (numbers of lines) and body.

    A hash rolls over the hashes of neighbouring worded lines, two at a time. A
    chunk starts at every line whose rolling hash is no multiple of BOUNDARY, at
    one that follows a line without a start, at the first and at the last but
    one. It ends with the first pair, its own or one of the next two, whose
    remainder is not 1, or with the last pair. So a chunk has two to four worded
    lines, nothing outside decides whether a line with a start by its hash
    starts one nor where it ends, and all worded lines lie in chunks. Lines
    without a word count only between others; a text with one worded line has
    no chunk.
    """

    def found(lines: Column) -> Column:
        worded = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(WORDED))
        return let(worded, lambda w: F.when(F.size(w) >= MIN_LINES, rolled(lines, w)))

    def rolled(lines: Column, w: Column) -> Column:
        hashes = F.transform(w, lambda i: _number(F.get(lines, i)))
        pairs = F.sequence(F.lit(0), F.size(w) - 2)
        rolling = lambda h: F.transform(pairs, lambda k: (F.get(h, k) * BASE + F.get(h, k + 1)) % MODULUS % BOUNDARY)
        return let(hashes, lambda h: let(rolling(h), lambda r: cut_up(lines, w, pairs, r)))

    def cut_up(lines: Column, w: Column, pairs: Column, r: Column) -> Column:
        top = F.size(w) - 2
        starts = F.filter(pairs, lambda k: (k == 0) | (k == top) | (F.get(r, k) != 0) | (F.get(r, k - 1) == 0))
        ends = lambda k: (k >= top) | (F.get(r, k) != 1)
        last = lambda k: F.get(w, F.when(ends(k), k + 1).when(ends(k + 1), k + 2).otherwise(k + 3))
        part = lambda a, b: F.struct(a.alias("no"), b.alias("last"), F.array_join(F.slice(lines, a + 1, b - a + 1), "\n").alias("body"))
        return F.transform(starts, lambda k: let(F.get(w, k), lambda a: let(last(k), lambda b: part(a, b))))

    return let(F.split(F.coalesce(text, F.lit("")), "\n", -1), found)


def _with_key(docs: DataFrame) -> DataFrame:
    """doc_id, text and two hashes of the text: rows that share them and the doc_id lose the same lines."""
    return docs.select("doc_id", F.xxhash64("text").alias("t1"), F.hash("text").alias("t2"), "text")


def repeated(units: DataFrame, at: Column, known: DataFrame | None = None) -> DataFrame:
    """The rows of ``units`` whose body occurs before, in the order of ``at``.

    ``units``: doc_id, t1, t2, no, body and others. Hashes are counted
    first, and a bitmap of those that repeat, of a fixed size, keeps most other
    bodies out of the comparison, which groups by the text itself. A hot body is
    dealt over slices, and its count and first place are repeated for each. Hot
    hashes are fewer than HOT_KEYS, as each has over that share of all copies, so
    their broadcast is bounded at any size. Units of ``known`` (doc_id, t1, t2, no)
    are left out; none of them may be the first of its body.
    """
    keyed = units.withColumn("h", F.xxhash64("body"))
    often = cut(keyed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "line-counts")
    limit = max(HOT_ROWS, (often.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    hot = often.select("h", F.ceil(F.col("n") / limit).cast("int").alias("slices")).where("slices > 1")
    slices = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
    own = F.pmod(F.xxhash64("doc_id", "t1", "no"), F.col("slices")).cast("int")
    some = may_hold(keyed, cut(hash_bitmap(often), "line-bitmap"))
    if known is not None:
        k = known.select(*[F.col(c).alias(f"k_{c}") for c in _PLACE])
        some = some.join(k.hint("merge"), [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in _PLACE], "left_anti")
    dealt = some.join(F.broadcast(hot), "h", "left").withColumn("slices", F.coalesce("slices", F.lit(1))).withColumn("slice", own)
    maybe = cut(dealt, "line-chunks")
    first = maybe.groupBy("h", "body").agg(F.min(at).alias("first"), F.max("slices").alias("slices"), F.count("*").alias("n")).where("n > 1")
    found = maybe.join(first.select("h", "body", "first", slices).hint("merge"), ["h", "slice", "body"])
    return found.where(at > F.col("first")).select(*units.columns)


def _without(docs: DataFrame, gone: DataFrame, added: dict[str, Column]) -> DataFrame:
    """``docs`` without the lines ``drop`` of ``gone`` for a row's doc_id and text, with n_lines, n_removed_lines and ``added``.

    Texts and lines to drop meet by a sort-merge join at every size: it may
    spill, and the small side is never broadcast.
    """
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines", *added)]
    d = gone.select(F.struct(F.col("doc_id"), "t1", "t2").alias("k"), F.struct(*[c for c in gone.columns if c not in ("doc_id", "t1", "t2")]).alias("gone"))
    rows = docs.select(F.struct(*kept_columns).alias("row"))
    text = F.col("row.text")
    same = F.col("row.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.xxhash64(text) == F.col("k.t1")) & (F.hash(text) == F.col("k.t2"))
    parts = let(
        F.split(text, "\n", -1),
        lambda lines: let(
            F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone.drop")),
            lambda keep: F.struct((F.size(lines) - F.size(keep)).cast("long").alias("n"), F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n").alias("kept")),
        ),
    )
    joined = rows.join(d.hint("merge"), same, "left").withColumn("part", F.when(F.col("gone").isNotNull(), parts))
    lines = F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.split(text, "\n", -1))).cast("long")
    return joined.select(
        *[F.coalesce("part.kept", "row.text").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in kept_columns],
        lines.alias("n_lines"),
        F.coalesce("part.n", F.lit(0).cast("long")).alias("n_removed_lines"),
        *[c.alias(n) for n, c in added.items()],
    )


def _later(docs: DataFrame, parts: Column, place: list[str], known: DataFrame | None = None) -> DataFrame:
    """doc_id, t1, t2, no, last of the parts that occur before, without those of ``known``.

    Parts are ordered by doc_id, a null one being the largest, and then by ``place``.
    """
    rows = _with_key(docs).select("doc_id", "t1", "t2", F.inline(parts))
    return repeated(rows, F.struct(F.col("doc_id").isNull(), "doc_id", *place), known).drop("body")


def _drops(later: DataFrame) -> DataFrame:
    """doc_id, t1, t2, chunks (how many go) and drop (numbers of lines) of the rows with parts that occur before."""
    lines = F.flatten(F.collect_set(F.sequence("no", "last")))
    return later.groupBy("doc_id", "t1", "t2").agg(F.count_distinct("no").alias("chunks"), F.array_distinct(lines).alias("drop"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """Remove multi-line chunks that occurred before, anywhere in the table.

    ``docs``: doc_id and text; other columns pass through. Adds n_lines,
    n_removed_lines and n_removed_chunks, in the place of columns of these names,
    and replaces text by the lines that are left. "Before" is a smaller doc_id (a
    null one is the largest), or an earlier line of the same doc_id. A null text
    stays null and has no lines. Rows that share a doc_id are told apart by their
    text; their equal chunks at equal places are all first. Lines without a word
    stay unless they lie within what is removed. A copy of a whole text of two or
    more worded lines loses all of those. A removed line has an equal one before
    it, so the first of equal lines always stays. An empty table gives no rows.
    """
    gone = cut(_drops(_later(docs, chunks(F.col("text")), ["no"])), "line-drops")
    return _without(docs, gone, {"n_removed_chunks": F.coalesce("gone.chunks", F.lit(0).cast("long"))})


def windows(text: Column) -> Column:
    """Each line with a word up to the next such line, as an array of no, last (numbers of lines) and body."""

    def found(lines: Column) -> Column:
        return let(
            F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(WORDED)),
            lambda w: F.transform(
                F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))),
                lambda no, k: let(
                    F.get(w, k + 1),
                    lambda last: F.struct(no.alias("no"), last.alias("last"), F.array_join(F.slice(lines, no + 1, last - no + 1), "\n").alias("body")),
                ),
            ),
        )

    return let(F.split(F.coalesce(text, F.lit("")), "\n", -1), found)


def passage_dedup(docs: DataFrame) -> DataFrame:
    """Remove every passage of two or more worded lines that occurred before, anywhere in the table.

    Content-defined chunks find most passages. A second pass finds what boundaries
    of chunks hide, by windows of two neighbouring worded lines, blank lines
    between them included; blank lines at a passage's ends stay. It leaves out the
    windows within a chunk that goes: each has an equal one in the chunk before,
    so none is the first of its body and the result is that of all windows. "Before" is a smaller doc_id (a null one is the largest), then a
    hash of the text, then an earlier line. A removed line has an equal one
    before it, so the first of equal lines always stays. Rows with equal doc_id
    and text count as one. Adds n_lines and n_removed_lines and replaces text;
    other columns pass through. A null text stays null.
    """
    place = ["t1", "t2", "no"]
    by_chunk = cut(_later(docs, chunks(F.col("text")), place), "chunk-repeats")
    within = by_chunk.select("doc_id", "t1", "t2", F.explode(F.sequence("no", F.col("last") - 1)).alias("no"))
    gone = _drops(by_chunk.unionByName(_later(docs, windows(F.col("text")), place, within)))
    return _without(docs, cut(gone, "passage-drops"), {})
