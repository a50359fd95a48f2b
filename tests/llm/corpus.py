"""A small corpus with every awkward row: nulls, empty and long texts, ties, repeats, near copies, extra columns."""

import random

SYLLABLES = "the an er in on st re ti es or al na lo ve mi".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


def documents(n: int = 120, seed: int = 7) -> list[tuple]:
    """Rows of doc_id, text, lang, source, n_chars, h, key, score: the last three clash with names in use elsewhere."""
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randint(3, 90)) for _ in range(n)]
    texts[3] = texts[4] = None
    texts[5] = ""
    texts[6] = " \t\n "
    texts[7] = texts[8] = texts[20] = texts[9]
    texts[10] = texts[9].replace(" ", "\n  ")
    texts[11] = sentence(rng, 20000)
    texts[12] = texts[11] + " tail"
    texts[13] = "ÀÉ ÎÜ straße K \u212a 中文 \U0001f600 words And ENDS."
    texts[14] = "one"
    texts[15] = "one two"
    texts[16] = "<|endoftext|> and <|im_start|>"
    rows = [(i, t, "en", f"src{i % 5}" if i % 17 else None, None, i, "k", 0.5) for i, t in enumerate(texts)]
    rows[30] = (None, *rows[30][1:])
    return [*rows, rows[40], rows[40]]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h int, key string, score double"
