import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, own string, key int, bucket int, shard int, p double, n int, label string, size int"


def docs(spark, rows):
    """documents with extra columns whose names operators use inside."""
    full = [(i, t, "en", s, len(t or ""), "x", 1, 2, 3, 0.5, 4, "y", 5) for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


def prose(seed, n, words=400):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY[:words]) for _ in range(n))


_rng = random.Random(0)
VOCABULARY = ["".join(_rng.choice("abcdefghijklmnop") for _ in range(_rng.randrange(2, 8))) for _ in range(2000)]


def edge_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long_ = prose(1, 30_000)
    rows = [(i, prose(i, 5 + i * 7 % 90), f"src{i % 5}") for i in range(60)]
    rows += [(100, None, "src0"), (101, "", None), (102, "   \n\t ", "src1"), (None, "no id here at all my friend", "src2"), (103, long_, "src3"), (104, long_, "src3")]
    rows += [(105, "twice the same row", "src4")] * 2 + [(106, "É ß 日本 text", None), (107, "one", "solo")]
    return rows


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
