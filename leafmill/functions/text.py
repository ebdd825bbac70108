"""Text expressions on pages: white space, blocks, tokens, joins. All are Columns without Python workers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as characters and as the inside of a regex class that Java and RE2 both read.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

#: Ideographs that join without a space. Fixed values.
IDEOGRAPHS = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"
#: Characters that the token estimate counts as CJK, another set. Fixed values.
CJK_TOKENS = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}"
#: What ends a sentence or block, for the end of a line without trailing white space. Fixed values.
SENTENCE_END = r"[。！？；?!.．)\]】」』\"'`]\z"
#: What opens a block, for the start of a line without leading white space. Fixed values.
BLOCK_START = rf"\A(?:#{{1,6}}[{SPACE}]|[-*+][{SPACE}]|\p{{Nd}}+\.[{SPACE}]|>[{SPACE}]|```|\|[{SPACE}])"
#: A table's separator row with two columns or more. Fixed values.
TABLE_SEPARATOR = rf"\A\|?[{SPACE}]*:?-{{2,}}:?[{SPACE}]*(?:\|[{SPACE}]*:?-{{2,}}:?[{SPACE}]*)+\|?\z"
#: Behind these no space is put. Fixed values.
OPENERS = "([{「『【《"
SUMMARY_MARK = "[…summary truncated to fit context window]"
#: A page that fell back to its text layer, with a layer and without; the beginning and end of its extract. Fixed values.
NOTICE = "*(vision model unavailable — falling back to PDF text layer; tables, figures, and layout are NOT preserved)*"
NOTHING = "*(vision model unavailable and PDF text layer is empty for this page — no content recovered)*"
SENTINEL = "(vision model unavailable for page"
SENTINEL_END = "; text-layer fallback emitted; treat as sentinel — no extractor payload available)\n"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACES))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def blocks(page: Column) -> Column:
    """Blocks of a page: what blank lines separate, without line breaks at the ends; blank ones go."""
    parts = F.transform(F.split(strip(page), rf"\n[{SPACE}]*\n", -1), lambda x: F.btrim(x, F.lit("\n")))
    return F.filter(parts, lambda x: ~is_blank(x))


def first_line(block: Column) -> Column:
    """The first line of a text that doesn't begin with white space."""
    return F.substring_index(block, "\n", 1)


def last_line(block: Column) -> Column:
    """The last line of a text that doesn't end with white space."""
    return F.substring_index(block, "\n", -1)


def is_open_row(line: Column) -> Column:
    """A table row that its line doesn't close."""
    return lstrip(line).startswith("|") & ~rstrip(line).endswith("|")


def without_repeated_header(block: Column) -> Column:
    """Without its first two lines, if it has three or more and the second is a table separator."""

    def rest(lines: Column) -> Column:
        repeated = (F.size(lines) >= 3) & strip(F.coalesce(F.get(lines, F.lit(1)), F.lit(""))).rlike(TABLE_SEPARATOR)
        return F.when(repeated, F.array_join(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")).otherwise(block)

    return bind(F.split(block, "\n", -1), rest)


def estimate_text_tokens(text: Column) -> Column:
    """A third of a token for each CJK character and a quarter for any other, both sums rounded up."""

    def sums(counts: Column) -> Column:
        return F.ceil(counts.cjk / F.lit(3.0)) + F.ceil((counts.all - counts.cjk) / F.lit(4.0))

    total = F.length(text)
    cjk = F.when(total == F.octet_length(text), 0).otherwise(total - F.length(F.regexp_replace(text, f"[{CJK_TOKENS}]", "")))
    return F.coalesce(bind(F.struct(total.alias("all"), cjk.alias("cjk")), sums), F.lit(0)).cast("long")


def strip_reasoning(text: Column) -> Column:
    """Without <think> blocks and white space at the ends; an open tag stays. Null is empty."""
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), "(?s)<think>.*?</think>", ""))


def truncate_summary(text: Column, most: Column | int) -> Column:
    """At most `most` characters, of which the middle goes and a mark stands for it; all of them if most <= 0. Where
    the mark doesn't fit, the beginning alone."""
    most = F.lit(most) if isinstance(most, int) else most
    budget = most - len(SUMMARY_MARK) - 2
    head = F.floor(budget / 2).cast("int")
    tail = (budget - head).cast("int")
    last = F.when(tail > 0, lstrip(F.right(text, tail))).otherwise("")
    marked = F.concat(rstrip(F.left(text, head)), F.lit("\n" + SUMMARY_MARK), bind(last, lambda x: F.when(x != "", F.concat(F.lit("\n"), x)).otherwise("")))
    return F.when((most <= 0) | (F.length(text) <= most), text).when(budget < 0, F.left(text, most)).otherwise(marked)


def smart_join(before: Column, after: Column) -> Column:
    """One space between, but none behind an opening bracket or beside an ideograph; an empty side gives the other."""

    def joined(sides: Column) -> Column:
        close = F.right(sides.a, F.lit(1)).rlike(rf"[({{\[「『【《{IDEOGRAPHS}]") | F.left(sides.b, F.lit(1)).rlike(f"[{IDEOGRAPHS}]")
        return F.when(sides.a == "", sides.b).when(sides.b == "", sides.a).when(close, F.concat(sides.a, sides.b)).otherwise(F.concat_ws(" ", sides.a, sides.b))

    return bind(F.struct(rstrip(before).alias("a"), lstrip(after).alias("b")), joined)


def data_url(content: Column, mime: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def image_reference(url: Column, content: Column, action: Column | None = None, mime: str = "image/jpeg") -> Column:
    """What a prompt has for an image: a sentinel with its type and base64, taken from a data address or from local
    content, behind the line of the action; where there is neither, the action, or else a placeholder. Fixed texts."""
    spoken = F.coalesce(action if action is not None else F.lit(None).cast("string"), F.lit(""))
    remote = url.rlike(r"\Ahttps?://") | (F.coalesce(url, F.lit("")) == "")
    inline = F.concat(F.lit("VISION_IMAGE:"), F.regexp_extract(url, r"\Adata:([^;,]*)", 1), F.lit(":"), F.regexp_extract(url, r"(?s),(.*)\z", 1))
    local = F.concat(F.lit(f"VISION_IMAGE:{mime}:"), F.regexp_replace(F.base64(content), r"\s", ""))
    sentinel = F.when(url.startswith("data:"), inline).when(~remote, local)
    missing = F.when(spoken != "", spoken).otherwise(F.concat(F.lit("(could not inline image at "), F.coalesce(url, F.lit("")), F.lit(")")))
    return F.when(sentinel.isNull(), missing).when(spoken != "", F.concat(spoken, F.lit("\n"), sentinel)).otherwise(sentinel)


def text_layer_fallback(layer: Column) -> Column:
    """The page that stands in when the model is out of reach."""
    return bind(strip(F.coalesce(layer, F.lit(""))), lambda x: F.when(x == "", NOTHING).otherwise(F.concat(F.lit(f"{NOTICE}\n\n```\n"), x, F.lit("\n```\n"))))


def fallback_sentinel(page_number: Column) -> Column:
    return F.format_string(f"{SENTINEL} %d{SENTINEL_END}", page_number)


def is_real_extract(extract: Column) -> Column:
    """Not empty, and its first 128 characters don't begin with the sentinel. False for null."""
    return F.coalesce((F.length(extract) > 0) & ~lstrip(F.left(extract, F.lit(128))).startswith(SENTINEL), F.lit(False))
