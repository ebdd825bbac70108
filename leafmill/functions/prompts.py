"""Prompt texts. The wording below is fixed: results depend on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import bind, is_blank, strip, truncate_summary

# Fixed values from here.
MAX_SUMMARY_CHARS = 800
VERBATIM_RULE = "Verbatim rule: copy the page character-for-character — no translation, summarization, or invented content; write `[illegible]` for unreadable glyphs."
LANGUAGE_RULE = "Language rule: write in the exact same language(s) as the source — preserve every CJK character, Latin word, and punctuation mark; never translate."
NO_REASONING = "Output ONLY final content; no reasoning, preamble, or <think>...</think> blocks."
RULES = f"{VERBATIM_RULE}\n\n{LANGUAGE_RULE}\n\n{NO_REASONING}"
HINT = (
    "Text-hint (extracted from the PDF's native text layer — treat as ground truth for prose, numbers, units, formula symbols, table cell content; "
    "use the image for layout, figures, and visual structure. If they disagree on order or wording, follow the image for structure and the text for exact wording):\n```\n"
)
FORMAT = "Rewrite the extracted markdown as strict CommonMark. Fix broken lists, normalize table syntax, strip OCR noise.\n\n" + RULES
REFORMAT = (
    "Rewrite the extracted markdown below as strict CommonMark. Preserve every word verbatim — do not drop, translate, or rewrite content. "
    f"Only normalize formatting; output language must exactly match the input.\n\n{RULES}\n\nExtracted content (read from disk; treat as ground truth):\n```\n"
)
SO_FAR, PREVIOUS = "Running summary of preceding pages:\n", "Previous running summary:\n"
ATTACH = ("Call your add_image tool with image_url=`", "` to attach the rendered page image, then transcribe its full content into raw markdown.\n\n")
FIRST_PAGE = "This is the first page; start a fresh summary.\n\n"
SUMMARIZE = (
    "Update the running summary to incorporate the current page. Keep the output under %d characters — preserve named entities, running arguments, and unresolved threads; "
    "drop settled details. If the previous summary was truncated to fit the context window, prioritize newly visible content when absorbing this page."
    f"\n\n{LANGUAGE_RULE}\n\n{NO_REASONING}"
)
EXTRACTOR = (
    "PDF Page Extractor. Transcribe every readable element of the page image into raw markdown (headings, paragraphs, lists, tables, alt-text for figures), preserving source language verbatim.\n\n"
    "You transcribe a PDF page image character-for-character into markdown, preserving the source language(s) without translation, summarization, or invention. "
    "Use `[illegible]` for unreadable glyphs and prefix short alt descriptions for non-text figures with `![...]()`. "
    "Preserve CJK characters, punctuation, layout, and mixed-language content exactly as drawn."
)
FORMATTER = (
    "Markdown Formatter. Rewrite extracted markdown as strict CommonMark: normalize tables, fix lists, strip OCR noise; preserve every word verbatim.\n\n"
    "You rewrite OCR-style markdown as strict CommonMark: normalize table syntax, fix broken lists, strip OCR noise. Never drop, translate, or rewrite content — "
    "every word, CJK character, and punctuation mark from the input must survive verbatim. Only normalize formatting; output language must exactly match input."
)
SUMMARIZER = (
    "Running Summary Keeper. Maintain a tight rolling summary of preceding pages so the next extractor has cross-page context.\n\n"
    "You maintain a tight rolling cross-page summary from prior summary + current page. Preserve named entities, unresolved threads, and arguments still evolving; drop settled details. "
    "Write in the dominant source language. If the prior summary was truncated to fit the context window, prioritize absorbing newly visible content."
)
# Fixed values end.

PERSONAS = (EXTRACTOR, FORMATTER, SUMMARIZER)


def persona_version(personas: Column) -> Column:
    """16 hex digits that name a set of persona texts (array of strings)."""
    return F.left(F.sha2(F.array_join(personas, "\x00"), 256), F.lit(16))


def backstory(persona: Column) -> Column:
    """What follows a persona's first blank line, or all of it."""
    at = F.instr(persona, "\n\n")
    return F.when(at > 0, strip(F.substring(persona, at + 2, F.length(persona)))).otherwise(persona)


def hint_block(layer: Column) -> Column:
    return bind(strip(F.coalesce(layer, F.lit(""))), lambda x: F.when(x == "", "").otherwise(F.concat(F.lit(HINT), x, F.lit("\n```\n\n"))))


def summary_block(summary: Column) -> Column:
    return F.when(is_blank(summary), "").otherwise(F.concat(F.lit(SO_FAR), summary, F.lit("\n\n")))


def extract_intro(image_path: Column) -> Column:
    return F.concat(F.lit(ATTACH[0]), image_path, F.lit(ATTACH[1]))


def extract_prompt(image_path: Column, layer: Column, summary: Column, most: int = MAX_SUMMARY_CHARS) -> Column:
    cut = truncate_summary(F.coalesce(summary, F.lit("")), most)
    return F.concat(bind(cut, summary_block), hint_block(layer), extract_intro(image_path), F.lit(RULES))


def format_prompt() -> Column:
    return F.lit(FORMAT)


def reformat_prompt(extract: Column) -> Column:
    return F.concat(F.lit(REFORMAT), extract, F.lit("\n```"))


def summarize_prompt(summary: Column, most: int = MAX_SUMMARY_CHARS) -> Column:
    """The summary before is given whole."""
    given = F.coalesce(summary, F.lit(""))
    before = F.when(is_blank(given), FIRST_PAGE).otherwise(F.concat(F.lit(PREVIOUS), given, F.lit("\n\n")))
    return F.concat(before, F.lit(SUMMARIZE % most))
