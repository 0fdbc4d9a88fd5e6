"""Line dedup by a tree of log templates.

Every line goes down a tree of fixed depth: by its number of tokens, then by its leading tokens, where
a token with a digit counts as a variable field. A leaf's template has the token that more than half of
the leaf's lines bear at a place, and a field where there is none. Lines that fit the template are its
instances; any other line is a template of its own. Templates that recur across documents are dropped
everywhere but in their first document.

Recurrence is counted over different texts, so that whole copies of a document, which are not the matter
of this operator, count once and do not lose their text. So do near copies of one another. Two things make a
near copy, and both are read from what does not recur in a text, its own lines: they leave its five-word
shingles alike to SIMILAR per cent, and more than half of their words are words of the texts it resembles (in their
recurring lines, or in the own lines of half of them), as in a line that was edited. A page that is
nothing but navigation around a few words of its own has other words than its neighbours, and counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch_path, scratch_scope

FIELD = "<*>"
LEADING = 3  # tokens that lead down the tree
MIN_DOCUMENTS = 10  # different texts with a recurring template
SHINGLE = 5  # words
SIMILAR = 80  # per cent of the shingles of near copies
LEAVES_SENT = 1_000_000  # a long each
MIN_FIXED = 60  # per cent of a leaf template's places that are no fields


def masked(line: Column) -> Column:
    """A line's tokens joined by single spaces, those with digits as fields."""
    plain = F.trim(F.regexp_replace(line, "[\\x20\\x09-\\x0D]+", " "))
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, "[^ ]*[0-9][^ ]*", FIELD)).otherwise(plain)


def _tokens(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1


def document_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, rank, masked, h, leaf, size, total) of every line with a token.

    th tells texts of one id apart; rank counts such lines only; size is the line's number of tokens, total the text's.
    """
    every = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("pos"), masked(x).alias("masked")))
    rows = docs.filter("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), F.filter(every, lambda x: x["masked"] != "").alias("lines"))
    rows = rows.withColumn("total", F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + _tokens(x["masked"])))
    # the outer form keeps the optimizer from computing the arrays once more to filter empty ones
    each = rows.select("doc_id", "th", "total", F.posexplode_outer("lines").alias("rank", "line")).filter("line IS NOT NULL")
    line, size = F.col("line.masked"), _tokens(F.col("line.masked"))
    return each.select(
        "doc_id", "th", F.col("line.pos").alias("pos"), "rank", line.alias("masked"), F.xxhash64(line).alias("h"),
        F.xxhash64(size, F.substring_index(line, " ", LEADING)).alias("leaf"), size.cast("long").alias("size"), "total",
    )


def leaf_templates(kinds: DataFrame, least: int, min_fixed: int = MIN_FIXED) -> DataFrame:
    """(h, template) of those distinct lines (leaf, h, masked, n) that fit the template of their leaf; template is the leaf.

    Only leaves with ``least`` lines of two kinds or more have something to generalise.
    """
    places = F.max(F.size(F.split("masked", " ", -1))).alias("places")
    total = kinds.groupBy("leaf").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), places)
    total = materialize(total.filter((F.col("kinds") > 1) & (F.col("total") >= least)).drop("kinds"), "leaves")
    tokens = F.posexplode_outer(F.split("masked", " ", -1)).alias("place", "token")
    each = kinds.select("leaf", "h", "n", tokens)
    borne = each.groupBy("leaf", "place", "token").agg(F.sum("n").alias("n"))
    fixed = borne.join(total, "leaf").filter("2 * n > total").select("leaf", "place", "token")
    valid = fixed.groupBy("leaf").agg(F.count("*").alias("fixed")).join(total, "leaf").filter(F.col("fixed") * 100 >= F.col("places") * min_fixed)
    agree = each.join(fixed, ["leaf", "place", "token"]).groupBy("leaf", "h").agg(F.count("*").alias("agree"))
    return agree.join(valid, "leaf").filter("agree = fixed").select("h", F.col("leaf").alias("template"))


def _first() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")).alias("first")


def _words(*keys: str) -> list[Column]:
    return [*(F.col(k) for k in keys), F.explode(F.array_distinct(F.split("masked", " ", -1))).alias("word")]


def near_copies(places: DataFrame, lines: DataFrame, kinds: DataFrame) -> DataFrame:
    """(th, copy): texts that are near copies of others, and what a group of them shares.

    ``places`` are the recurring lines (th, rank, h, size, total, mark) of different texts. Texts whose smallest mark
    is the same are a group.
    """
    # consecutive lines keep the difference of rank and row number
    run = F.expr("rank - row_number() OVER (PARTITION BY th ORDER BY rank)").alias("run")
    runs = places.select("th", "size", "total", "mark", run).groupBy("th", "run").agg(
        F.sum("size").alias("size"), F.max("total").alias("total"), F.min("mark").alias("mark")
    )
    shared = F.sum(F.greatest(F.col("size") - (SHINGLE - 1), F.lit(0)))
    texts = runs.groupBy("th").agg(shared.alias("shared"), F.max("total").alias("total"), F.min("mark").alias("copy"))
    texts = texts.withColumn("shingles", F.greatest(F.col("total") - (SHINGLE - 1), F.lit(1)))
    alike = texts.filter(F.col("shared") * 100 >= (F.col("shingles") * 2 - F.col("shared")) * SIMILAR).select("th", "copy")
    alike = materialize(alike, "alike")
    sizes = alike.groupBy("copy").agg(F.count("*").alias("texts"))
    # equal texts have equal lines
    slim = lines.select("th", "rank", "masked").join(alike, "th").dropDuplicates(["th", "rank"])
    own = slim.join(places.select("th", "rank"), ["th", "rank"], "left_anti").select(*_words("copy", "th")).distinct()
    own = materialize(own, "own_words")
    frequent = own.groupBy("copy", "word").agg(F.count("*").alias("n")).join(sizes, "copy").filter("2 * n >= texts").select("copy", "word")
    theirs = places.select("th", "h").join(alike, "th").select("copy", "h").distinct().join(kinds.select("h", "masked"), "h")
    common = frequent.union(theirs.select(*_words("copy"))).distinct().withColumn("known", F.lit(1))
    judged = own.join(common, ["copy", "word"], "left").groupBy("th").agg(F.count("*").alias("n"), F.count("known").alias("n_known"))
    other = judged.filter("2 * n_known <= n").select("th")
    return alike.join(other, "th", "left_anti")


def recurring_lines(docs: DataFrame, least: int = MIN_DOCUMENTS) -> DataFrame:
    """(doc_id, th, pos): the lines to drop, those whose template is in ``least`` texts.

    Lines are unfolded and stored once. Leaves are counted first, and only lines of leaves with enough of them go
    further; these leaves are sent to the lines up to LEAVES_SENT of them. Counting combines before each shuffle, so
    that a line found everywhere is a few rows per task.
    """
    lines = materialize(document_lines(docs), "lines")
    leaves = lines.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("leaf")
    leaves = materialize(leaves, "leaves")
    side = F.broadcast(leaves) if leaves.count() <= LEAVES_SENT else leaves
    crowded = materialize(lines.join(side, "leaf", "left_semi"), "crowded")
    kinds = materialize(crowded.groupBy("leaf", "h").agg(F.min("masked").alias("masked"), F.count("*").alias("n")), "kinds")
    named = kinds.select("h", "n", F.md5(F.col("masked").cast("binary")).alias("mark")).join(leaf_templates(kinds, least), "h", "left")
    named = materialize(named.select("h", "n", "mark", F.coalesce("template", "h").alias("template")), "templates")
    enough = named.groupBy("template").agg(F.sum("n").alias("lines"), F.min("mark").alias("mark")).filter(F.col("lines") >= least).select("template", "mark")
    candidates = named.select("h", "template").join(enough, "template")
    found = crowded.select("doc_id", "th", "pos", "rank", "h", "size", "total").join(candidates, "h")
    found = materialize(found, "found")
    texts = found.groupBy("template", "mark", "th").agg(_first())
    often = texts.groupBy("template").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("template")
    often = materialize(often, "often")
    again = materialize(texts.join(often, "template"), "again")
    places = found.join(often, "template").select("th", "rank", "h", "size", "total", "mark").distinct()
    copies = near_copies(materialize(places, "places"), lines, kinds)
    # two columns: a template's hash never passes for that of a text
    known = again.join(copies, "th", "left").select("template", "copy", F.when(F.col("copy").isNull(), F.col("th")).alias("own"), "first")
    groups = known.groupBy("template", "copy", "own").agg(F.min("first").alias("first"))
    dropped = groups.groupBy("template").agg(F.count("*").alias("n"), F.min("first").alias("first")).filter(F.col("n") >= least)
    gone = found.join(dropped.select("template", "first"), "template")
    gone = gone.filter(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))))
    return gone.select("doc_id", "th", "pos").distinct()


def drop_recurring_lines(docs: DataFrame, least: int = MIN_DOCUMENTS) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``; a column n_chars, if there is one, follows the text.

    A text whose lines are all dropped is empty. Null and empty texts, null ids, repeated rows and all
    other columns stay as they are; every row is returned. A line without tokens is never dropped.

    Texts are always dealt out by a shuffle: the size of the packed file of dropped places, by which Spark would choose
    a broadcast, says little about their size in memory. All other tables are removed before that.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "gone")
    with scratch_scope(spark):
        gone = recurring_lines(docs, least).groupBy("doc_id", "th").agg(F.collect_set("pos").alias("gone"))
        gone = materialize(gone.select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th"), "gone"), path=path)
    gone = gone.hint("shuffle_hash")
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("text").alias("row_th"))
    both = left.join(gone, F.col("row.doc_id").eqNullSafe(F.col("gone_id")) & (F.col("row_th") == F.col("gone_th")), "left")
    kept = F.filter(F.split("row.text", "\n", -1), lambda line, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    columns = []
    for c in docs.columns:
        value = F.col(f"row.`{c}`")
        if c == "text":
            value = text
        elif c == "n_chars":
            value = F.when(F.col("gone").isNull(), value).otherwise(F.length(text).cast(docs.schema[c].dataType))
        columns.append(value.alias(c))
    return both.select(*columns)


def line_report(docs: DataFrame, least: int = MIN_DOCUMENTS) -> DataFrame:
    """doc_id, n_chars before, n_left after, and text_sha256 of the text that is left, for each row (null for a null text)."""
    slim = docs.select("doc_id", "text", F.length("text").cast("long").alias("n_before"))
    left = drop_recurring_lines(slim, least)
    return left.select(
        "doc_id", F.col("n_before").alias("n_chars"), F.length("text").cast("long").alias("n_left"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )
