"""Rows and column names that operators must stand."""

LONG = " ".join(f"lang{i}" for i in range(30_000))
BASE = " ".join(f"word{i}" for i in range(80))
NEAR = BASE.replace("word40", "other")
#: doc_id, text, source: nulls, blanks, ties, repeated rows, copies, near copies, a very long text.
ROWS = [
    (1, BASE, "b"), (2, BASE, "b"), (3, NEAR, "a"), (4, NEAR + " tail", None), (5, None, "a"), (6, "", "a"), (7, " \t\n ", "b"), (8, "one two", "c"),
    (9, "ONE two", "c"), (10, LONG, "a"), (11, LONG + " x", "a"), (12, "Ünïcode ❤ text " * 40, "b"), (None, BASE, "b"), (None, None, None),
    (13, "repeated row here with some words", "c"), (13, "repeated row here with some words", "c"), (14, BASE[:300] + " fresh " + BASE[300:], "d"),
    (15, "abc " * 200, "a"), (16, "x" * 5000, "b"),
]
CLASHING = ["key", "row", "sid", "n", "token", "digest", "w", "size", "rank", "bucket", "target", "component", "start", "grams"]
