"""Documents with every awkward case: nulls, empty and long texts, copies, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, part string, tile string, spans string, bucket string, item string, words string, block string, position string"
ENGLISH = "the and of to in that is was for with this not from have but they which one all their".split()
GERMAN = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split()


def sentence(draw: random.Random, words: list[str], n: int) -> str:
    return " ".join(draw.choice(words) + (draw.choice("abcdefgh") * draw.randint(0, 2)) for _ in range(n))


def rows() -> list[tuple]:
    draw = random.Random(5)
    out: list[tuple] = []

    def add(doc_id, text, lang="en", source="a"):
        out.append((doc_id, text, lang, source, None if text is None else len(text), *["x"] * 9))

    for i in range(40):
        german = i % 3 == 0
        add(i, "\n".join(sentence(draw, GERMAN if german else ENGLISH, draw.randint(5, 40)) for _ in range(draw.randint(1, 6))), "de" if german else "en", None if i % 7 == 0 else "abc"[i % 3])
    passage = sentence(draw, ENGLISH, 70)
    add(50, passage + "\n" + sentence(draw, ENGLISH, 30))
    add(51, sentence(draw, ENGLISH, 12) + " " + passage)
    add(52, passage)
    base = sentence(draw, ENGLISH, 120).split()
    add(53, " ".join(base))
    add(54, " ".join(base))  # an exact copy
    add(55, " ".join(base[:-1] + ["changed"]))  # a near one
    add(56, " ".join(base).upper())  # the same words
    add(60, None)
    add(61, "")
    add(62, " \n\t \n")
    add(63, "12 # $ %% ...\n12 # $ %% ...")
    add(64, "one")
    add(65, "naïve ÉTÉ straße 日本語 テキスト 😀 İ ǅ\r\nline two\x1c odd", "fr")
    add(66, None, None, None)
    add(67, "word " * 3000)  # long, and the same word throughout
    add(68, "\n".join(sentence(draw, ENGLISH, 9) for _ in range(1500)))  # very long
    add(70, "a repeated row that is long enough\nwith two lines")
    add(70, "a repeated row that is long enough\nwith two lines")
    add(70, "another text of the same id that is long enough")
    add(None, "a row without an id that is long enough\na repeated row that is long enough")
    add(None, passage)
    return out


def table(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
