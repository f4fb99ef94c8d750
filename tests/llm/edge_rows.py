"""A table that every operator must take."""

#: Rows that every operator must take: nulls, empties, ties, repeats, long and odd texts.
EDGES = [
    (1, "The cat sat on the mat and looked at the dog, then it left for good."),
    (2, "The cat sat on the mat and looked at the dog, then it left for good."),
    (2, "The cat sat on the mat and looked at the dog, then it left for good."),
    (3, None),
    (4, ""),
    (None, ""),
    (None, "Ein Text ohne Nummer, aber mit Wörtern."),
    (5, " \n\t "),
    (6, "12345 --- !!!"),
    (7, "word " * 30_000),
    (8, "x" * 70_000),
    (9, "é😀中\u0301 \x00 \x1c a\xa0b <|endoftext|> <|startoftext|>"),
    (10, "one two"),
    (2**62 + 1, "Mail me: a.b+c@example.co.uk or +1 (555) 123-4567, 10.0.0.1, 4111 1111 1111 1111."),
    (-5, "tail space \n"),
]
