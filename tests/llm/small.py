"""Small tables with every awkward case, and plain versions of the contracts."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, kept string, text_key string, shard int"


def words(text):
    return WORD.findall(text or "")


def prose(rng, n):
    vocabulary = [f"{a}{b}{c}" for a in "bdgkt" for b in "aeiou" for c in ("n", "r", "st", "lé")]
    return " ".join(rng.choice(vocabulary) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def corpus(n=60, seed=5):
    """(doc_id, text): nulls, blanks, short and very long texts, copies, near copies, passages."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    rows = [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one"), (1004, "one"), (None, "no id " + prose(rng, 40)), (1005, "a " * 500)]
    for i in range(n):
        text = "\n".join(prose(rng, rng.randint(5, 60)) for _ in range(rng.randint(1, 5)))
        if i % 6 == 0:
            text += "\n" + passage + "\n" + prose(rng, 20)
        rows.append((i, text))
        if i % 10 == 0:
            rows.append((500 + i, text))
        if i % 10 == 5:
            w = text.split(" ")
            w[len(w) // 2] = "zzz"
            rows.append((600 + i, " ".join(w)))
    rows.append((2000, prose(rng, 30_000)))
    rows.append(rows[-2])  # a repeated row
    return rows


def frame(spark, rows, parts=3):
    full = [(d, t, "en" if (d or 0) % 3 else None, f"s{(d or 0) % 2}", None, "x", "k", "t", 7) for d, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)
