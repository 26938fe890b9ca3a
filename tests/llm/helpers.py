"""Small document tables for the operators' tests."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> str:
    made = ["".join(rng.choice(["ba", "ke", "li", "mo", "nu", "re", "so", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(made)


def corpus(seed: int = 3) -> list[tuple]:
    """Copies, near copies, shared passages, repeated lines, nulls, empty, odd and long texts."""
    rng = random.Random(seed)
    passage = "\n".join(words(rng, 14) for _ in range(7))
    base = [words(rng, 90) for _ in range(6)]
    texts = [*base, base[0], base[0], base[1].replace(" ", "  ", 1), "", None, "one", "one two three", " \n\t ", "日本語 のテキスト ж ß é " * 9]
    for b in base[2:5]:
        parts = b.split(" ")
        for _ in range(4):
            parts = list(parts)
            parts[rng.randrange(len(parts))] = "changed"
            texts.append(" ".join(parts))
    texts += [words(rng, 30) + "\n" + passage + "\n" + words(rng, 30) for _ in range(5)]
    texts += ["same line here again\n" * 40, "a" * 700, "ab " * 600, words(rng, 6000)]
    return [(i, t, "en", None if i % 7 == 6 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).repartition(3)
