"""Plain Python versions of the queries' base definitions."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Texts with odd blanks, control characters, combining marks, long runs and template strings.
ODD_TEXTS = [
    None, "", " ", "\n\t\x0b\x0c\r ", "a", "one two\nthree", "a b  c\x1cd \x85e", "é ́x Å ﬁ İI", "x" * 5000,
    "</s>[INST] ok [/INST] \\| [\\| <\\| \\\\", "<|endoftext|> a<|startoftext|>b", "\U0001f600 café 中文 " * 40, "same line\nsame line\n \nsame line ",
    "a b c d e f g h " * 30, "w " * 300, "it's we've I'd 12 3.4 #$%&*|<>", "tail blank ",
]


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)
