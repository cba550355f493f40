"""Tables for these tests."""

#: Names that the operators use inside; a table may have columns of such names.
CLASHING = "n_tokens node label score token bucket line place key words start spans rank first n h1 text_ v q component_id __x DOC".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, ids=None):
    """A documents table of the given texts with columns that clash with inner names."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "src0", None if t is None else len(t)) + ("x",) * len(CLASHING) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA + "".join(f", {c} string" for c in CLASHING))
