"""Small tables with every awkward case."""

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or add.
CLASHES = ("size", "_key", "_cell", "slot", "Shard", "score", "fp", "root", "row", "digest", "in_0", "taken", "label", "at", "window", "rule")


def documents(spark, rows, clash=True):
    """rows: (doc_id, text, source)."""
    df = spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], DOCUMENTS)
    if clash:
        for n, c in enumerate(CLASHES):
            df = df.selectExpr("*", f"'x{n}' AS `{c}`")
    return df


def awkward(spark, clash=True):
    """Null ids, texts and sources, empty and very long texts, blanks, repeated rows, copies, a lone surrogate's stand-in."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return documents(spark, [
        (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one two three", "b"), (4, "one two three", "b"), (None, "one two three", None), (None, None, None),
        (5, long, "a"), (6, "x" * 50_000, "c"), (7, "Caf\u00e9 \U0001F600 \\ </turn> ###", "\U0001F600"), (8, "a", "a"), (9, "one  two\nthree", "b"), (10, "\x00 \x1f", "c")], clash)


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def schema_of(df):
    return [(f.name, f.dataType) for f in df.schema]

