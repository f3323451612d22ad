"""Rows that every operator on texts must take: nulls, no words, repeats, ties, long texts."""

SF = "/root/testdata/sf0.001"

LONG = " ".join(f"word{k} is here" for k in range(30_000))
ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", None, "a"), (4, "one", "en", "a"), (5, "one", "en", "b"), (5, "one", "en", "b"),
       (None, "no id at all", "en", "b"), (7, "Été à la plage, ñandú!", "fr", "c"), (8, LONG, "en", "a"), (9, LONG + " end", "en", None),
       (10, "a\0b zero byte", "en", "c"), (11, "😀 smile " * 3, None, "c")]
