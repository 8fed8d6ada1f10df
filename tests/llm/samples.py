"""Invented rows for the tests."""

import random
import zlib

SYLLABLES = "ba be bi bo ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so".split()


def prose(seed, words=60):
    """Invented words, by a seeded rule."""
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(words))


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


ODD_ROWS = [(None, None), (None, "no id at all"), (900, None), (901, ""), (902, "  \n\t "), (903, "é"),
            (904, "!!! ... ???"), (905, "日本語のテキスト"), (906, "a" * 70_000), (906, "a" * 70_000), (907, "twin"), (908, "twin")]
