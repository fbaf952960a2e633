"""Small tables with the cases that every corpus operator must define."""

from lendframe.llm.decontaminate import words

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i % 997}" for i in range(30_000))


def edge_docs(spark, extra="score double, h string, items string, t string, n bigint"):
    """Nulls in any column, empty, blank and very long texts, copies, repeated rows, and columns with names used inside."""
    rows = [(1, "The cat sat on the mat.", "en"), (2, None, None), (3, "", "en"), (4, "   \n\t ", "en"), (5, LONG, "en"),
            (6, "The cat sat on the mat.", "fr"), (7, "The cat sat on the mat!", "en"), (7, "The cat sat on the mat!", "en"),
            (None, "no id at all", "en"), (9, "é▁ßß 日本語 \U0001F600 x", None), (10, "one", "en"), (11, "", None)]
    data = [(i, t, la, "src", None if t is None else len(t), 1.5, "z", "y", "q", 3) for i, t, la in rows]
    return spark.createDataFrame(data, DOCS + ", " + extra)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def brute_windows(text, width=10):
    w = words((text or "").encode())
    return w, [w[i:i + width] for i in range(max(1, len(w) - width + 1))] if w else []


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[max(self.find(a), self.find(b))] = min(self.find(a), self.find(b))
