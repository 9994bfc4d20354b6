"""Small corpora with the awkward cases every text operator has to take."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, blob string"


def awkward(seed: int = 7, n: int = 60) -> list[tuple]:
    """Random texts plus null and empty ones, copies, near copies, repeats inside a text and odd white space."""
    r = random.Random(seed)
    vocab = [a + b for a in "abcdefgh" for b in ("", "o", "é", "ung")]
    texts = [" ".join(r.choice(vocab) for _ in range(r.choice([1, 3, 19, 20, 21, 60, 200]))) for _ in range(n)]
    passage = " ".join(r.choice(vocab) for _ in range(45))
    texts += [f"{texts[0]} {passage} {texts[1]}", f"{passage}\n\t{texts[2]}", passage, passage, passage.replace(" ", "\t\x0b ")]
    texts += [texts[5]] * 4 + [texts[6] + " x", "A b " * 40, "a " * 70, "", None, " \n\t", "x", "   y\u0085z"]
    texts += [" ".join(vocab * 120)]
    return [(i * 3 % 97 + (i // 97) * 97, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None, i, "clash") for i, t in enumerate(texts)]


def frame(spark, rows, schema=DOC_SCHEMA):
    return spark.createDataFrame(rows, schema)
