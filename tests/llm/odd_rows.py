"""Rows that must not make an operator fail: nulls, blanks, repeats, taken ids, very long texts."""

ODD = [
    (None, "a text without an id, of more than a few words, to be told apart"),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "short text here"),
    (5, "short text here"),
    (6, "short text here"),
    (7, "x" * 70_000),
    (8, "word " * 30_000),
    (9, "ÄÖÜ ßé 日本語 \U0001f600 á 12345 ...,,,"),
    (9, "another text under an id that is taken, which is odd but must not fail"),
    (None, None),
]
