"""Cross-page stitching: pages of a document become one text, with paragraphs and tables joined over page ends."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators.stitcher import stitch_pages

PAGE_BREAK = "\n\n---\n\n"
MODES = ("off", "heuristic", "heuristic_compat")


def stitch(pages: DataFrame, mode: str = "heuristic", doc_id: str = "doc_id", page: str = "page_number", markdown: str = "markdown", strategy: str = "native") -> DataFrame:
    """(doc_id, markdown, n_chars, n_pages): one row for each document, its pages in order of their numbers.

    `off` puts a page break between pages, blank ones too. `heuristic` joins the first block of a page to the last of the
    one before where that one is unfinished. `heuristic_compat` keeps a defect of the rules as first written: it loses the joined
    paragraph, when the page that goes on has further blocks. Null pages are blank. (doc_id, page) is a key; rows that
    share it stand in the order of their blocks.

    `native` makes one shuffle by doc_id and no Python worker: what a join depends on is put into a small struct for
    each page before the shuffle, a fold over these structs decides, and the texts are joined once, so the work is in
    proportion to the text however long a paragraph grows. `pandas` folds in Python workers, as a cross-check."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}, got {mode!r}")
    given = pages.select(F.col(doc_id).alias("doc_id"), F.col(page).alias("page_number"), F.coalesce(F.col(markdown), F.lit("")).alias("markdown"))
    if mode == "off":
        ordered = F.array_sort(F.collect_list(F.struct("page_number", "markdown")))
        out = given.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.array_join(F.transform(ordered, lambda x: x.markdown), PAGE_BREAK).alias("markdown"))
    elif strategy == "pandas":
        id_type = given.schema["doc_id"].dataType.simpleString()
        out = given.groupBy("doc_id").applyInPandas(lambda rows: _folded(rows, mode), f"doc_id {id_type}, n_pages long, markdown string")
    else:
        featured = given.select("doc_id", "page_number", page_features(F.col("markdown")).alias("f"))
        rows = F.array_sort(F.collect_list(F.struct("page_number", "f")))
        gathered = featured.groupBy("doc_id").agg(F.count("*").alias("n_pages"), rows.alias("rows"))
        out = gathered.select("doc_id", "n_pages", assemble(F.filter("rows", lambda x: x.f.n > 0), mode == "heuristic_compat").alias("markdown"))
    return out.select("doc_id", "markdown", F.length("markdown").alias("n_chars"), "n_pages")


def start_of(line: Column) -> Column:
    return bind_left(line, lambda c: F.when(c == "#", "#").when(c == "|", "|").otherwise(""))


def bind_left(line: Column, body) -> Column:
    return X.bind(F.left(X.lstrip(line), F.lit(1)), body)


def page_features(markdown: Column, texts: bool = True) -> Column:
    """What the decisions about a page need: its blocks (with `texts`) and their number; whether the first opens a block and is one line only;
    how its last line starts and ends; its last character's effect on a join."""

    def of(blocks: Column) -> Column:
        first, last = F.coalesce(F.get(blocks, F.lit(0)), F.lit("")), F.coalesce(F.get(blocks, F.size(blocks) - 1), F.lit(""))
        return X.bind(F.struct(blocks.alias("b"), first.alias("first"), X.last_line(X.rstrip(last)).alias("tail")), described)

    def described(x: Column) -> Column:
        return F.struct(
            *([x.b.alias("blocks")] if texts else []),
            F.size(x.b).alias("n"),
            X.first_line(x.first).rlike(X.BLOCK_START).alias("opens"),
            (~x.first.contains("\n")).alias("one_line"),
            start_of(x.tail).alias("start"),
            x.tail.endswith("|").alias("bar"),
            x.tail.rlike(X.SENTENCE_END).alias("finished"),
            F.left(x.first, F.lit(1)).rlike(f"[{X.IDEOGRAPHS}]").alias("tight_head"),
            F.right(x.tail, F.lit(1)).rlike(rf"[({{\[「『【《{X.IDEOGRAPHS}]").alias("tight_tail"),
        )

    return X.bind(X.blocks(markdown), of)


def boundary(start: Column, before: Column, after: Column) -> Column:
    """How a page's first block stands to the text before, whose last line starts with `start` and whose page has the
    features `before`: "table" or "text" if it goes on with it, else "new"."""
    return (
        F.when(start == "#", "new")
        .when((start == "|") & ~before.bar, "table")
        .when(~before.finished & ~after.opens, "text")
        .otherwise("new")
    )


def decisions(features: Column) -> Column:
    """An array of (kind, start) for pages in order: "first", or boundary() to the page before; `start` is that of the last
    line of the text so far. A one-line page that goes on with a line keeps its start, which is all the state."""

    def step(state: Column, i: Column) -> Column:
        def decided(kind: Column) -> Column:
            inherits = (kind == "text") & (F.get(features, i).n == 1) & F.get(features, i).one_line
            return F.concat(state, F.array(F.struct(kind.alias("kind"), F.when(inherits, F.get(state, i - 1).start).otherwise(F.get(features, i).start).alias("start"))))

        return X.bind(boundary(F.get(state, i - 1).start, F.get(features, i - 1), F.get(features, i)), decided)

    empty = F.array().cast("array<struct<kind:string,start:string>>")
    begun = F.array(F.struct(F.lit("first").alias("kind"), F.get(features, F.lit(0)).start.alias("start")))
    return F.when(F.size(features) == 0, empty).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(features) - 1, F.lit(1))), begun, lambda s, i: F.when(i < F.size(features), step(s, i)).otherwise(s)))


def lost_tails(features: Column, kinds: Column) -> Column:
    """For each page whether its last block is lost in the compatible mode: it is if the next page goes on with it and has
    further blocks, or goes on with it as its only block that is lost in turn."""
    goes_on = lambda i: F.get(kinds, i).kind.isin("text", "table")

    def step(later: Column, i: Column) -> Column:  # from the last page to the first; later[0] is that of page i + 1
        lost = goes_on(i + 1) & ((F.get(features, i + 1).n > 1) | F.get(later, F.lit(0)))
        return F.concat(F.array(F.coalesce(lost, F.lit(False))), later)

    n = F.size(features)
    return F.aggregate(F.sequence(F.greatest(n - 2, F.lit(0)), F.lit(0)), F.array(F.lit(False)), lambda s, i: F.when(n >= 2, step(s, i)).otherwise(s))


def assemble(rows: Column, compat: bool) -> Column:
    """The text of pages (page_number, f) in order, none of them blank."""

    def joined(x: Column) -> Column:
        pieces = F.transform(x.f, lambda f, i: page_text(x, f, i))
        return F.regexp_replace(F.array_join(pieces, ""), r"\A\n\n", "")

    def page_text(x: Column, f: Column, i: Column) -> Column:
        kind, previous = F.get(x.kinds, i).kind, F.get(x.f, i - 1)
        n, first = f.n, F.get(f.blocks, F.lit(0))
        tight = previous.tight_tail | f.tight_head
        head = (
            F.when(kind == "table", F.concat(F.lit(" |\n"), X.lstrip(X.without_repeated_header(first))))
            .when(kind == "text", F.concat(F.when(tight, "").otherwise(" "), first))
            .otherwise(F.concat(F.lit("\n\n"), first))
        )
        if compat:
            goes_on, lost = kind.isin("text", "table"), F.get(x.lost, i)
            head = F.when(F.when(n == 1, lost).otherwise(goes_on), "").otherwise(head)
            rest = F.when(lost, F.slice(f.blocks, F.lit(2), F.greatest(n - 2, F.lit(0)))).otherwise(F.slice(f.blocks, F.lit(2), F.greatest(n - 1, F.lit(0))))
        else:
            rest = F.slice(f.blocks, F.lit(2), F.greatest(n - 1, F.lit(0)))
        return F.concat(head, F.array_join(F.transform(rest, lambda b: F.concat(F.lit("\n\n"), b)), ""))

    def decided(f: Column) -> Column:
        return X.bind(F.struct(f.alias("f"), decisions(f).alias("kinds")), told)

    def told(x: Column) -> Column:
        lost = lost_tails(x.f, x.kinds) if compat else F.array(F.lit(False))
        return X.bind(F.struct(x.f.alias("f"), x.kinds.alias("kinds"), lost.alias("lost")), joined)

    return X.bind(F.transform(rows, lambda r: r.f), decided)


def boundaries(pages: DataFrame, doc_id: str = "doc_id", page: str = "page_number", markdown: str = "markdown") -> DataFrame:
    """(doc_id, page_number, kind) for each page that isn't blank: "first", "new", "text" or "table"."""
    rows = pages.select(F.col(doc_id).alias("doc_id"), F.col(page).alias("page_number"), page_features(F.coalesce(F.col(markdown), F.lit("")), texts=False).alias("f"))
    gathered = rows.groupBy("doc_id").agg(F.filter(F.array_sort(F.collect_list(F.struct("page_number", "f"))), lambda r: r.f.n > 0).alias("rows"))
    kinds = X.bind(F.transform("rows", lambda r: r.f), lambda f: X.bind(decisions(f), lambda k: k))
    each = gathered.select("doc_id", F.explode(F.arrays_zip(F.transform("rows", lambda r: r.page_number).alias("page_number"), F.transform(kinds, lambda k: k.kind).alias("kind"))).alias("x"))
    return each.select("doc_id", "x.page_number", "x.kind")


def _folded(rows: pd.DataFrame, mode: str) -> pd.DataFrame:
    ordered = rows.sort_values(["page_number", "markdown"])
    return pd.DataFrame({"doc_id": [rows.doc_id.iloc[0]], "n_pages": [len(rows)], "markdown": [stitch_pages(ordered.markdown, mode == "heuristic_compat")]})
