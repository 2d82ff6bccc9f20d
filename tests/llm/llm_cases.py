"""Odd rows that every operator must handle, and the smallest tables."""

FOLDER = "/root/testdata/sf0.001"

ODD = [
    (0, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu."), (1, None), (2, ""), (3, " \t\n\x0b\f\r"), (None, "a null id"), (None, None),
    (4, "same  text"), (4, "same  text"), (5, "same text"), (6, "sametext"), (7, "é" * 700), (8, "x"), (9, "!!! ... ???"),
    (10, "word " * 3000), (11, "a  b \n c\x01d <|endoftext|> 's 12"), (12, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu."),
]
