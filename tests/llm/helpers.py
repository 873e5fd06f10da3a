import random

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"
#: Names that operators use inside themselves.
CLASHES = ("n", "row", "key", "node", "component", "word", "place", "tile", "role", "gone", "kept", "fp", "of", "size", "score", "line", "unit", "block", "named")


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(doc_id, text, source) rows with columns that clash with inner names."""
    df = spark.createDataFrame([(a, b, c, None, *(["x"] * len(CLASHES))) for a, b, c in rows], "doc_id bigint, text string, source string, lang string, " + ", ".join(f"`{c}` string" for c in CLASHES))
    return df


def odd_rows(seed: int = 1) -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeéñß") for _ in range(draw.randint(1, 9)))
    rows = [(i, "\n".join(" ".join(word() for _ in range(draw.randint(1, 12))) for _ in range(draw.randint(1, 4))), f"s{i % 5}") for i in range(40)]
    rows += [(100, None, "s1"), (101, "", "s1"), (102, "   \n\t ", None), (103, "word", None), (None, "no id here", "s2"), (None, None, None)]
    rows += [(104, " ".join(word() for _ in range(30_000)), "s3"), (105, "z" * 50_000, "s4"), (106, "   x\x1cy", "s0")]
    rows += [rows[3], rows[3], rows[7]] + [(200 + i, rows[5][1], "s0") for i in range(30)]
    return rows


def classes(ids: list, linked) -> dict:
    """Smallest reachable id, by brute force over all pairs."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if linked(a, b):
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
