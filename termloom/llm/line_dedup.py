"""Line dedup by a tree of line templates (DataFrame functions only).

A line is parsed by a tree of fixed depth. Its tokens with digits are variable fields and become ``<*>``. The first
level is the number of tokens, the next are the leading tokens. Below them a leaf holds the line's exact template,
and for lines of ``min_tokens`` or more also three general ones: the tokens fall into three runs, and each general
template leaves one run variable. Lines that differ in one run only thus meet in a template. Shorter lines have the
exact one only, or, from ``short_tokens`` tokens on, also one for each token after the leading ones left variable.

A template that enough different documents have is recurring. Its first line (by document, then place) stays, all
others are dropped. Long lines recur from ``min_docs_long`` documents on, shorter ones, which chance repeats, from
``min_docs``.

With ``exact_tokens``, lines that two documents have token for token are looked at too, in ``passage_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import text_or_empty, write_shared

PAGE = 256
#: A whole token with a digit in it. Possessive, so that long tokens are scanned once.
VARIABLE = r"(?<!\S)[^\s0-9]*+[0-9]\S*"


def _document(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit(id_col), F.col(id_col), F.col(text_col))


def _key(*parts: Column) -> Column:
    """96 bits of two hash functions, so that foreign lines do not meet by chance among very many."""
    return F.struct(F.xxhash64(*parts).alias("a"), F.hash(*parts).alias("b"))


def template_keys(tokens: Column, n: Column, leading: int, min_tokens: int, short_tokens: int | None = None) -> Column:
    """Keys of a line's templates: the exact one, then one for each run of tokens left variable, or, in a line of
    ``short_tokens`` or more that is too short for runs, one for each token left variable."""
    third = F.floor(n / 3).cast("int")
    ends = [F.lit(0), third, 2 * third, n]
    runs = [_key(F.slice(tokens, ends[i] + 1, ends[i + 1] - ends[i])) for i in range(3)]
    head = _key(F.slice(tokens, 1, leading))
    general = [_key(F.lit(i), head, *[runs[j] for j in range(3) if j != i]) for i in range(3)]
    exact = _key(F.lit(3), *runs)
    keys = F.when(n >= min_tokens, F.array(exact, *general))
    if short_tokens is not None:
        places = F.sequence(F.lit(leading), n - 1)  # fewer than min_tokens
        one = F.transform(places, lambda i: _key(F.lit(4), i, F.slice(tokens, F.lit(1), i), F.slice(tokens, i + 2, n)))
        keys = keys.when(n >= max(short_tokens, leading + 1), F.concat(F.array(exact), one))
    return keys.otherwise(F.array(exact))


def _tokens(line: Column) -> Column:
    return F.array_remove(F.split(line, r"\s+"), "")


def parse_lines(
    docs: DataFrame, id_col: str, text_col: str, leading: int, min_tokens: int, exact: bool = False, short_tokens: int | None = None
) -> DataFrame:
    """One row per line that is not blank: doc_id, doc, place, n, keys; with ``exact`` also a hash of its own tokens."""
    text = text_or_empty(text_col)
    masked = F.when(text.rlike("[0-9]"), F.regexp_replace(text, VARIABLE, "<*>")).otherwise(text)
    split = F.split(masked, "\n")
    if exact:  # masking changes no white space, so both have the same lines
        split = F.arrays_zip(split.alias("line"), F.split(text, "\n").alias("own"))
    lines = docs.select(F.col(id_col).alias("doc_id"), _document(id_col, text_col).alias("doc"), F.posexplode(split).alias("place", "line"))
    line = F.col("line.line") if exact else F.col("line")
    lines = lines.withColumn("tokens", _tokens(line)).withColumn("n", F.size("tokens")).where("n > 0")
    columns = ["doc_id", "doc", "place", "n", template_keys(F.col("tokens"), F.col("n"), leading, min_tokens, short_tokens).alias("keys")]
    if exact:
        own = F.when(F.col("line.own") == F.col("line.line"), F.col("tokens")).otherwise(_tokens(F.col("line.own")))
        columns.append(_key(own).alias("exact"))
    return lines.select(*columns)


def recurring_lines(lines: DataFrame, long_tokens: int, min_docs_long: int, min_docs: int) -> DataFrame:
    """(doc_id, doc, place) of the lines to drop."""
    spread = lines.select("n", F.explode("keys").alias("key"), "doc").groupBy("n", "key")
    # Only templates that two documents have are looked at closer. This and the next table are written, so that the
    # joins with them shuffle both sides and Spark can split a template that very many lines have.
    shared = spread.agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low != high").select("n", "key")
    shared = write_shared(shared, "line-shared")
    seen = lines.select("doc_id", "doc", "place", "n", F.explode("keys").alias("key")).join(shared, ["n", "key"])
    seen = write_shared(seen, "line-seen")
    by_doc = seen.groupBy("n", "key", "doc").agg(F.min(F.struct("doc_id", "doc", "place")).alias("first"))
    enough = F.when(F.col("n") >= long_tokens, min_docs_long).otherwise(min_docs)
    recurring = by_doc.groupBy("n", "key").agg(F.count(F.lit(1)).alias("docs"), F.min("first").alias("first"))
    recurring = write_shared(recurring.where(F.col("docs") >= enough).select("n", "key", "first"), "line-recurring")
    later = ~F.struct("doc_id", "doc", "place").eqNullSafe(F.col("first"))
    return seen.join(recurring, ["n", "key"]).where(later).select("doc_id", "doc", "place").distinct()


def passage_lines(lines: DataFrame, dropped: DataFrame, exact_tokens: int, passage_words: int) -> DataFrame:
    """(doc_id, doc, place) of the lines to drop: those in ``dropped``, and copies of lines that two documents have
    token for token. A copy of ``exact_tokens`` or more goes; a shorter one where it stands in a run of lines that are
    all copies or in ``dropped``, and have more than ``passage_words`` tokens together. Blank lines end no run.
    """
    place = F.struct("doc_id", "doc", "place")
    shared = lines.groupBy("n", "exact").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.min(place).alias("first"))
    # Written for the same reason as the tables of templates.
    shared = write_shared(shared.where("low != high").select("n", "exact", "first"), "line-copies")
    copies = lines.join(shared, ["n", "exact"]).where(~place.eqNullSafe(F.col("first")))
    marks = [
        lines.select("doc", "doc_id", "place", "n", F.lit(0).alias("mark")),
        copies.select("doc", "doc_id", "place", "n", F.lit(1).alias("mark")),
        dropped.select("doc", "doc_id", "place", F.lit(0).alias("n"), F.lit(2).alias("mark")),
    ]
    marked = marks[0].unionByName(marks[1]).unionByName(marks[2]).groupBy("doc", "doc_id", "place")
    marked = marked.agg(F.max("n").alias("n"), F.max("mark").alias("mark"))
    # Lines of a run have as many lines that stay before them.
    before = Window.partitionBy("doc", "doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = marked.withColumn("run", F.sum((F.col("mark") == 0).cast("int")).over(before)).where("mark > 0")
    marked = marked.withColumn("words", F.sum("n").over(Window.partitionBy("doc", "doc_id", "run")))
    goes = (F.col("mark") == 2) | (F.col("n") >= exact_tokens) | (F.col("words") > passage_words)
    return marked.where(goes).select("doc_id", "doc", "place")


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    leading: int = 2,
    min_tokens: int = 9,
    long_tokens: int = 20,
    min_docs_long: int = 2,
    min_docs: int = 10,
    exact_tokens: int | None = None,
    passage_words: int = 50,
    short_tokens: int | None = None,
) -> DataFrame:
    """All rows and columns of ``docs`` in a struct ``doc``, with ``text`` (the lines that stay), ``lines`` and
    ``dropped`` (how many there were, and how many went).

    Lines end at a line feed; blank lines always stay. Null text stays null with no lines; an empty text has one
    blank line. Lines and texts of any length are read whole. A line that recurs within one document only stays. Documents are told apart by id and text: rows
    that repeat both count as one and lose the same lines; null ids sort first. An empty table gives an empty
    result. Columns of any name pass through untouched.

    With ``exact_tokens``, lines of as many tokens also go when an earlier line is the same token for token and two
    documents have it, and shorter ones where they stand in a passage of such lines of over ``passage_words`` words.
    With ``short_tokens``, lines of as many tokens that are too short for runs have templates with one token variable.
    """
    lines = write_shared(parse_lines(docs, id_col, text_col, leading, min_tokens, exact_tokens is not None, short_tokens), "lines")
    dropped = recurring_lines(lines, long_tokens, min_docs_long, min_docs)
    if exact_tokens is not None:
        dropped = passage_lines(lines, dropped, exact_tokens, passage_words)
    pages = dropped.groupBy("doc", "doc_id", F.floor(F.col("place") / PAGE).cast("int").alias("page"))
    pages = pages.agg(F.collect_set((F.col("place") % PAGE).cast("int")).alias("gone"))  # PAGE places at most
    # A row per document, no larger than the document's own number of lines.
    marks = pages.groupBy("doc", "doc_id").agg(F.map_from_entries(F.collect_list(F.struct("page", "gone"))).alias("gone"))
    marks = marks.select(F.col("doc").alias("key"), F.col("doc_id").alias("key_id"), "gone")

    rows = docs.select(F.struct("*").alias("doc"), _document(id_col, text_col).alias("key_of"), F.col(id_col).alias("id_of"))
    joined = rows.join(marks.hint("shuffle_hash"), (F.col("key_of") == F.col("key")) & F.col("id_of").eqNullSafe(F.col("key_id")), "left")
    original = F.col("doc").getField(text_col).cast("string")
    split = F.split(F.coalesce(original, F.lit("")), "\n")
    numbers = F.sequence(F.lit(0), F.floor((F.size(split) - 1) / PAGE).cast("int"))
    cut = F.transform(numbers, lambda p: F.struct(F.slice(split, p * PAGE + 1, PAGE).alias("lines"), F.element_at("gone", p).alias("gone")))
    kept = F.flatten(F.transform(cut, lambda c: F.filter(c["lines"], lambda _, i: ~F.coalesce(F.array_contains(c["gone"], i), F.lit(False)))))
    gone = F.aggregate(F.map_values("gone"), F.lit(0), lambda n, places: n + F.size(places))
    return joined.select(
        "doc",
        F.when(F.col("gone").isNull(), original).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.when(original.isNull(), 0).otherwise(F.size(split)).alias("lines"),
        F.coalesce(gone, F.lit(0)).alias("dropped"),
    )
