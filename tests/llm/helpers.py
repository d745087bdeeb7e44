import os
import random
import re

WORDS = [f"{a}{b}" for a in ("the", "an", "tion", "lo", "é", "Ri") for b in ("ra", "ne", "st", "qu", "")]


def texts(seed, n, most=120):
    rng = random.Random(seed)
    out = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, most))) for _ in range(n)]
    for k in range(0, n, 5):  # exact copies, near copies and shared passages
        out[(k + 1) % n] = out[k]
        words = out[k].split(" ")
        words[rng.randrange(len(words))] = "changed"
        out[(k + 2) % n] = " ".join(words)
        out[(k + 3) % n] += " " + out[k][:90]
    return out


ODD = [None, "", " ", "\n\n", "x", "ÿ é", "a" * 5000, "😀" * 300, "tab\tand\r\nreturn", "nul\0byte", "  two  spaces ", "trailing\n"]


def frame(spark, rows, extra=True):
    """doc_id, text and columns whose names the operators use themselves."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    return spark.createDataFrame([(i, t, 1, "k", b"x") for i, t in rows], "doc_id long, text string, n_words int, block string, kept binary")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def vocabulary(name):
    return os.path.join("/opt/tokenizers", name)
