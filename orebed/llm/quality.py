"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much text is rejected.

Rows: a null text has no words and fails the base rules. Lines without a word are neither judged nor counted. Equal rows each
give a row.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame

from orebed.llm.frames import map_columns, pick

SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
# What navigation bars and page furniture say.
SEPARATORS = frozenset(["|", "»", "«", "›", "‹", "•", "·", ">", ">>", "/"])
NAVIGATION = frozenset(["home", "menu", "login", "logout", "next", "previous", "search", "contact", "about", "sitemap", "share", "help", "back", "top", "faq"])
BOILERPLATE = re.compile(r"(?ai)\b(?:enable javascript|javascript is (?:disabled|required)|cookie policy|uses cookies|accept (?:all )?cookies|privacy policy|terms of (?:use|service)|all rights reserved|lorem ipsum|subscribe to our newsletter|click here|read more|skip to (?:main )?content)\b")
ENDS = re.compile(r"[.!?…:;。！？][\"'”’»)\]*]*$")
RUNS = re.compile(r"([!?#$%&*<=>@^_|~+])\1")


@dataclass(frozen=True)
class Rules:
    """min_words, max_repeated: the base rules. The others are the line rules and the loss that rejects a document."""

    min_words: int = 50
    max_repeated: float = 0.5
    end_words: int = 8
    max_run_words: float = 0.3
    max_separators: float = 0.2
    navigation_words: int = 8
    max_loss: float = 0.5


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, covered, end = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    seen: set[str] = set()
    lines = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += line in seen
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), lines, repeated_words(words)


def line_fault(line: str, last: bool, rules: Rules) -> str | None:
    """The first rule that a line with a word fails: navigation, boilerplate or punctuation."""
    words = [w.decode() for w in line.encode().split()]
    if len(words) >= 3 and sum(w in SEPARATORS for w in words) > rules.max_separators * len(words):
        return "navigation"
    if len(words) <= rules.navigation_words and 2 * sum(w.strip(".,:;!?|()").lower() in NAVIGATION for w in words) > len(words):
        return "navigation"
    if BOILERPLATE.search(line):
        return "boilerplate"
    if RUNS.search(line) and sum(1 for w in words if RUNS.search(w)) > rules.max_run_words * len(words):
        return "punctuation"
    # the last line may have been cut short
    return "punctuation" if not last and len(words) >= rules.end_words and not ENDS.search(line.rstrip(SPACES)) else None


def clean(text: str, rules: Rules) -> tuple[str, dict[str, int], int]:
    """The text without its failing lines, how many lines fell to each rule, and the code points of words lost."""
    out, faults, lost = [], {}, 0
    lines = text.split("\n")
    last = max((i for i, x in enumerate(lines) if x.strip(SPACES)), default=-1)
    for i, line in enumerate(lines):
        if line.strip(SPACES) and (fault := line_fault(line, i == last, rules)):
            faults[fault] = faults.get(fault, 0) + 1
            lost += len(line) - sum(map(line.count, SPACES))
        else:
            out.append(line)
    return "\n".join(out), faults, lost


def judge(docs: DataFrame, rules: Rules = Rules(), texts: bool = True) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, lines removed by rule, word characters lost, and cleaned_text (if texts).

    kept: the base rules hold, and at most max_loss of the words' characters went with failing lines.
    """

    def run(ids: list, given: list) -> tuple[list, ...]:
        out: list[list] = [[] for _ in range(12)]
        for t in given:
            t = t or ""
            counts = base_counts(t)
            n_words, chars, repeats = counts[0], counts[1], counts[4]
            failed = n_words < rules.min_words or repeats > rules.max_repeated * n_words
            cleaned, faults, lost = clean(t, rules)
            row = *counts, failed, not failed and lost <= rules.max_loss * chars, *(faults.get(k, 0) for k in ("punctuation", "navigation", "boilerplate")), lost, cleaned if texts else None
            for column, value in zip(out, row, strict=True):
                column.append(value)
        return ids, *out

    made = map_columns(
        pick(docs, "doc_id", "text"), run,
        f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
        "punctuation_lines long, navigation_lines long, boilerplate_lines long, lost_chars long, cleaned_text string",
    )
    return made if texts else made.drop("cleaned_text")


def cleaned(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The kept rows of docs (doc_id, text, n_chars and others), their text without failing lines and n_chars to match."""
    names = docs.columns
    text, chars = names.index("text"), names.index("n_chars")

    def run(*columns: list) -> tuple[list, ...]:
        out = []
        for row in zip(*columns):
            words, _, _, _, repeats = base_counts(row[text] or "")
            if words >= rules.min_words and repeats <= rules.max_repeated * words:
                short, _, lost = clean(row[text], rules)
                if lost <= rules.max_loss * (len(row[text]) - sum(map(row[text].count, SPACES))):
                    new = list(row)
                    new[text], new[chars] = short, len(short)
                    out.append(new)
        return tuple(map(list, zip(*out))) if out else tuple([] for _ in names)

    return map_columns(docs, run, ", ".join(f"`{name}` {kind}" for name, kind in docs.dtypes))
