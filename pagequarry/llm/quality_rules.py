"""Line-first cleaning.

Every line with a word is tried against rules for punctuation, navigation and
boilerplate; failing lines go. A document is rejected if its lines lose more than
a share of its characters, or if the base rules reject it.

A line fails as
* punctuation: over a tenth of its characters outside words' separators are of
  ``#*$%&|<>``, or two words and a fifth of its words or more end in two or more exclamation
  or question marks, or it has fewer than four words and no letter;
* navigation: at least two words of its own are only a separator such as ``|`` or
  ``>``, and these are a fifth of its words or more;
* boilerplate: it equals an earlier line of the document, or it holds a set phrase
  of notices and page furniture.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame

from .common import keyed, map_batches, texts_of

MIN_WORDS = 50
MAX_REPEAT = 50  # per cent of words in repeated windows
MAX_LOST = 0.5  # share of the words' characters
MAX_SYMBOLS = 0.1
MAX_SHOUTED = 0.2
MAX_SEPARATORS = 0.2
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
# Separators of menus, and phrases of page furniture.
SEPARATORS = ("|", ">", "<", "»", "«", "·", "•", "/", ">>", "<<")
PHRASES = (
    "accept all cookies", "all rights reserved", "back to top", "click here to", "cookie policy", "cookie settings",
    "enable javascript", "forgot your password", "javascript is disabled", "lorem ipsum", "privacy policy",
    "share on facebook", "sign up for our newsletter", "skip to content", "subscribe to our newsletter", "terms of use",
    "we use cookies",
)

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SHOUT = re.compile(r"[!?]{2,}(?=[\x20\x09-\x0D]|\Z)")
_ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def count_any(text: str, chars: str) -> int:
    return sum(map(text.count, chars))


def repeat_words(words: list, width: int = 3) -> int:
    """Words inside windows that occur twice or more, the first time included."""
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, total = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + width - max(covered, i)
            covered = i + width
    return total


def line_fails(line: str, words: list[str]) -> str | None:
    """The rule that a line with these words fails, or None."""
    chars = sum(map(len, words))
    if count_any(line, SYMBOLS) > MAX_SYMBOLS * chars and not _separated(words):
        return "punctuation"
    if ("!!" in line or "?" in line) and len(_SHOUT.findall(line)) >= max(2, MAX_SHOUTED * len(words)):
        return "punctuation"
    if len(words) < 4 and not any(map(str.isalpha, line)):
        return "punctuation"
    if _separated(words):
        return "navigation"
    low = line.translate(_ASCII_LOWER)
    return "boilerplate" if any(p in low for p in PHRASES) else None


def _separated(words: list[str]) -> bool:
    n = sum(map(words.count, SEPARATORS))
    return n >= 2 and n >= MAX_SEPARATORS * len(words)


def judge(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, clean text, base_failed, kept."""
    words = _WORD.findall(text)
    n_words, word_chars = len(words), len(text) - count_any(text, SPACES)
    repeated = repeat_words(words)
    dup = lost = 0
    seen, clean = set(), []
    for line in text.split("\n"):
        if own := _WORD.findall(line):
            if line in seen:
                dup += 1
                lost += sum(map(len, own))
                continue
            seen.add(line)
            if line_fails(line, own):
                lost += sum(map(len, own))
                continue
        clean.append(line)
    failed = n_words < MIN_WORDS or 100 * repeated > MAX_REPEAT * n_words
    return n_words, word_chars, count_any(text, SYMBOLS), dup, repeated, lost, "\n".join(clean), failed, not failed and lost <= MAX_LOST * word_chars


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "clean_text", "base_failed", "kept")


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: the id, counts, the cleaned text and the verdict.

    A null text has no words, so it fails the base rules and stays unkept; a null id
    stays null; repeated rows are judged alike and all returned. Very long texts are read
    in full, line by line; an empty table gives no rows. A line that several rules fail is told by the first.
    """

    def judged(batch):
        rows = [judge(t) for t in texts_of(batch.column(1))]
        return {"doc_id": batch.column(0)} | dict(zip(NAMES, map(list, zip(*rows))))

    longs = ", ".join(f"{n} long" for n in NAMES[:6])
    return map_batches(keyed(docs, id_col, text_col), judged, f"doc_id long, {longs}, clean_text string, base_failed boolean, kept boolean")
