"""From lines to sections: boilerplate, footnotes, headings, section chunks; and chunks of bounded size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line_no (from 1) and line of every line."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).select(key, (F.col("pos") + 1).alias("line_no"), "line")


def boilerplate_keys(rows: DataFrame, key: str, page: str, line: str = "line", share: float = 0.3, least_pages: int = 2) -> DataFrame:
    """Line keys on at least `share` of a document's pages, and on least_pages pages at least, so that short documents keep
    their lines. Columns: key, line_key, pages, total."""
    keyed = rows.withColumn("line_key", T.line_key(F.col(line))).where("line_key <> ''")
    # one aggregation for pages of keys, one for the document; both are partial before the shuffle
    total = rows.groupBy(key).agg(F.countDistinct(page).alias("total"))
    pages = keyed.groupBy(key, "line_key").agg(F.countDistinct(page).alias("pages")).where(F.col("pages") >= least_pages)
    return pages.join(total, key).where(F.col("pages") >= F.col("total") * share)


def drop_boilerplate(rows: DataFrame, keys: DataFrame, key: str, line: str = "line") -> DataFrame:
    """Rows whose line key is not boilerplate; lines without a letter stay."""
    keyed = rows.withColumn("line_key", T.line_key(F.col(line)))
    return keyed.join(keys.select(key, "line_key"), [key, "line_key"], "left_anti").drop("line_key")


def footnote_state(rows: DataFrame, key: str, order: Sequence[str], footnote: Column, heading: Column) -> DataFrame:
    """rows with in_footnote: the last event up to here was a footnote, or the one before this heading was, for a heading
    ends a footnote and goes with it."""
    events = rows.withColumn("event", F.when(footnote, "footnote").when(heading, "heading"))
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    state = F.coalesce(F.last("event", True).over(before), F.lit("")) == "footnote"
    return events.withColumn("in_footnote", state | (F.coalesce("event", F.lit("")) == "footnote")).drop("event")


def keep_lines(rows: DataFrame, key: str, order: Sequence[str], line: str, heading: Column) -> DataFrame:
    """Lines without footnotes, links, empty, contents and dotted lines, in that order of tests."""
    rows = footnote_state(rows, key, order, T.is_footnote_source(F.col(line)), heading).where(~F.col("in_footnote")).drop("in_footnote")
    rows = rows.withColumn(line, T.remove_links(F.col(line))).where(F.col(line) != "")
    return rows.where(~T.is_contents_line(F.col(line)) & ~T.is_dot_line(F.col(line)))


def sections(rows: DataFrame, key: str, order: str, line: str, heading: Column, page: str) -> DataFrame:
    """A row for each section that has lines: section (heading number, 0 before the first), heading, text, start_page, end_page."""
    numbered = rows.withColumn("is_heading", heading)
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = numbered.withColumn("section", F.sum(F.col("is_heading").cast("int")).over(upto))
    body = F.collect_list(F.when(~F.col("is_heading"), F.struct(order, line)))
    out = numbered.groupBy(key, "section").agg(
        F.max(F.when(F.col("is_heading"), F.col(line))).alias("heading"),
        F.array_join(F.transform(F.array_sort(body), lambda x: x[line]), "\n").alias("text"),
        F.min(F.when(~F.col("is_heading"), F.col(page))).alias("start_page"),
        F.max(F.when(~F.col("is_heading"), F.col(page))).alias("end_page"),
    )
    return out.where("text <> ''")


def merge_hyphens(c: Column) -> Column:
    """Lines (an array) with a line that ends in a hyphen joined to the next one, if that starts in lower case or with no
    capital, digit or bracket; a joined line is not looked at again."""
    return fold_pairs(c, lambda a, b: a.rlike(r"-$") & (b.rlike(r"^\p{Ll}") | ~b.rlike(r"^[A-Z\d(\[{]")), lambda a, b: F.concat(F.regexp_replace(a, "-$", ""), F.ltrim(b)))


def join_paragraphs(c: Column) -> Column:
    """Lines joined to the next one where the line has no closing mark anywhere and the next one goes on in lower case, is
    no list item or bullet and has several words; pairs only."""
    return fold_pairs(
        c,
        lambda a, b: ~a.rlike(r"[.!?:;]") & b.rlike(r"^\p{Ll}") & ~b.rlike(r"^\d+[.)]\s") & ~b.rlike(r"^[•\-*]") & (F.size(T.tokens(b)) > 1),
        lambda a, b: F.concat(T.strip(a), F.lit(" "), T.strip(b)),
    )


def fold_pairs(c: Column, joins, join) -> Column:
    """Left to right: a line that joins the next is merged with it and both are done."""

    def step(state: Column, b: Column) -> Column:
        merge = state["open"].isNotNull() & joins(state["open"], b)
        done = F.when(merge, F.concat(state["done"], F.array(join(state["open"], b)))).when(
            state["open"].isNotNull(), F.concat(state["done"], F.array(state["open"]))
        ).otherwise(state["done"])
        return F.struct(done.alias("done"), F.when(merge, F.lit(None).cast("string")).otherwise(b).alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))
    return F.aggregate(c, start, step, lambda s: F.when(s["open"].isNotNull(), F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))


def halves(ws: Column) -> Column:
    mid = F.floor(F.size(ws) / 2).cast("int")
    return F.array(F.slice(ws, 1, mid), F.slice(ws, mid + 1, F.size(ws)))


def split_oversize(df: DataFrame, text: str, most: int, index: str) -> DataFrame:
    """Texts of more than `most` characters halved by words, and halves that still are once more. split_index is a string:
    the row's own index, with the places of the halves behind it; oversized_split tells whether the text was cut."""
    whole = F.col(index).cast("string")
    first = F.transform(halves(T.tokens(F.col(text))), lambda ws, i: F.struct(F.array_join(ws, " ").alias("t"), i.alias("i")))
    second = F.flatten(
        F.transform(
            first,
            lambda x: F.when(
                F.length(x["t"]) > most,
                F.transform(halves(T.tokens(x["t"])), lambda ws, j: F.struct(F.array_join(ws, " ").alias("t"), F.concat_ws("_", x["i"].cast("string"), j.cast("string")).alias("i"))),
            ).otherwise(F.array(F.struct(x["t"].alias("t"), F.concat_ws("_", x["i"].cast("string"), F.lit("0")).alias("i")))),
        )
    )
    long = F.length(text) > most
    parts = F.when(long, second).otherwise(F.array(F.struct(F.col(text).alias("t"), F.lit("").alias("i"))))
    out = df.withColumn("part", F.explode(F.filter(parts, lambda x: x["t"] != "")))
    at = F.when(F.col("part.i") == "", whole).otherwise(F.concat_ws("_", whole, F.col("part.i")))
    out = out.withColumn("oversized_split", long).withColumn("split_index", at)
    return out.withColumn(text, F.col("part.t")).drop("part")


def merge_small(df: DataFrame, by: Sequence[str], order: Sequence[str], text: str, least: int, most: int) -> DataFrame:
    """Per group in order: a text shorter than `least` is appended to the one before it if both fit `most`, else put before
    the next one, which is then done, else kept. Columns: by, chunk (from 1), text, merged."""
    sort = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("t"))))
    lists = df.groupBy(*by).agg(F.transform(sort, lambda x: x["t"]).alias("ts"))
    chunk = "array<struct<t:string,merged:boolean>>"

    def one(t: Column, merged: bool) -> Column:
        return F.array(F.struct(t.alias("t"), F.lit(merged).alias("merged")))

    def step(state: Column, t: Column) -> Column:
        out, wait = state["out"], state["wait"]
        last = F.element_at(out, -1)
        joined = F.concat(last["t"], F.lit("\n\n"), t)
        small = F.length(t) < least
        fits = (F.size(out) > 0) & (F.length(last["t"]) + F.length(t) <= most)
        now = (
            F.when(wait.isNotNull(), F.concat(out, one(F.concat(wait, F.lit("\n\n"), t), True)))
            .when(small & fits, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), one(joined, True)))
            .when(small, out)
            .otherwise(F.concat(out, one(t, False)))
        )
        return F.struct(now.cast(chunk).alias("out"), F.when(wait.isNull() & small & ~fits, t).alias("wait"))

    start = F.struct(F.array().cast(chunk).alias("out"), F.lit(None).cast("string").alias("wait"))
    end = lambda s: F.when(s["wait"].isNotNull(), F.concat(s["out"], one(s["wait"], False))).otherwise(s["out"])
    folded = lists.select(*by, F.posexplode(F.aggregate("ts", start, step, end)).alias("pos", "c"))
    return folded.select(*by, (F.col("pos") + 1).alias("chunk"), F.col("c.t").alias(text), "c.merged")


def context_budget(df: DataFrame, by: Sequence[str], order: Sequence[str], text: str, budget: int = 12_000) -> DataFrame:
    """Rows in order while the sum of their tokens is within budget; the first overflow ends it. Columns tokens, running."""
    df = df.withColumn("tokens", T.token_count(F.col(text)))
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum("tokens").over(upto)).where(F.col("running") <= budget)


def pack_sentences(df: DataFrame, text: str, target: int = 300, most: int = 380, overlap: int = 40, least: int = 40) -> DataFrame:
    """df with pieces: sentences packed to about `target` tokens and `most` at most, each piece led by the last sentences
    of the one before, `overlap` tokens of them at most; longer sentences are cut by words. Pieces of fewer than `least`
    tokens go unless all are that short."""
    cut = lambda s: F.when(
        T.token_count(s) > most,
        F.transform(
            F.sequence(F.lit(0), F.floor((F.size(T.tokens(s)) - 1) / (target // 2)).cast("int")),
            lambda i: F.array_join(F.slice(T.tokens(s), i * (target // 2) + 1, target // 2), " "),
        ),
    ).otherwise(F.array(s))
    units = F.flatten(F.transform(T.sentences(F.col(text)), cut))
    kind = "array<string>"

    def tail(now: Column) -> Column:
        """The longest run of last sentences within the overlap."""
        start = F.struct(F.array().cast(kind).alias("kept"), F.lit(0).alias("n"), F.lit(True).alias("on"))

        def back(s: Column, x: Column) -> Column:
            n = s["n"] + T.token_count(x)
            take = s["on"] & (n <= overlap)
            return F.struct(F.when(take, F.concat(F.array(x), s["kept"])).otherwise(s["kept"]).alias("kept"), F.when(take, n).otherwise(s["n"]).alias("n"), take.alias("on"))

        return F.aggregate(F.reverse(now), start, back, lambda s: s["kept"])

    def step(s: Column, x: Column) -> Column:
        full = (F.size(s["now"]) > 0) & (s["n"] + T.token_count(x) > target)
        kept = tail(s["now"])
        kept_n = F.aggregate(kept, F.lit(0), lambda n, y: n + T.token_count(y))
        now = F.when(full, F.concat(kept, F.array(x))).otherwise(F.concat(s["now"], F.array(x)))
        n = F.when(full, kept_n + T.token_count(x)).otherwise(s["n"] + T.token_count(x))
        done = F.when(full, F.concat(s["done"], F.array(F.array_join(s["now"], " ")))).otherwise(s["done"])
        return F.struct(done.alias("done"), now.alias("now"), n.alias("n"))

    start = F.struct(F.array().cast(kind).alias("done"), F.array().cast(kind).alias("now"), F.lit(0).alias("n"))
    pieces = F.aggregate(units, start, step, lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(F.array_join(s["now"], " ")))).otherwise(s["done"]))
    out = df.withColumn("pieces", pieces)
    long = F.filter("pieces", lambda p: T.token_count(p) >= least)
    return out.withColumn("pieces", F.when(F.size(long) > 0, long).otherwise(F.col("pieces")))


def merge_overlaps(c: Column, most: int = 8) -> Column:
    """Pieces (an array) joined to one text, words that end one piece and begin the next counted once, up to `most`."""

    def joined(text: Column, a: Column, b: Column) -> Column:
        """The text and the piece's words b, less those that end the text, whose last words are a."""
        sizes = F.filter(
            F.sequence(F.lit(most), F.lit(1), F.lit(-1)),
            lambda n: (n <= F.size(a)) & (n <= F.size(b)) & (F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n) == F.slice(b, 1, n)),
        )
        n = F.coalesce(F.get(sizes, F.lit(0)), F.lit(0))
        return F.concat_ws(" ", text, F.array_join(F.slice(b, n + 1, F.greatest(F.size(b), F.lit(1))), " "))

    def step(text: Column, piece: Column) -> Column:
        # both are cut to words once
        both = T.let(T.tokens(text), lambda a: T.let(T.tokens(piece), lambda b: joined(text, a, b)))
        return F.when(text == "", piece).otherwise(both)

    return T.strip(F.aggregate(c, F.lit(""), step))
