"""Texts with the awkward cases that every operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> list[str]:
    """Words of syllables, some with capitals, accents and punctuation."""
    syllables = ["an", "er", "th", "é", "ion", "ñu", "st", "re"]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n)]
    return [w.title() if rng.random() < 0.1 else w + rng.choice(["", "", "", ",", ".", "!"]) for w in words]


def texts() -> list[str | None]:
    """Copies, near copies, shared passages and lines, short, empty, null and odd texts."""
    rng = random.Random(4)
    passage = " ".join(prose(rng, 60))
    line = "This very line stands in Many documents"
    base = prose(rng, 120)
    out: list[str | None] = [None, "", " \t\n", "one", "two words", "İstanbul ÀÉ \x85 x y\xa0z", "a\x0bb\x0cc", "\n\n", line, line.upper()]
    for i in range(14):
        own = prose(rng, rng.choice([3, 20, 40, 150]))
        if i % 3 == 0:
            own[len(own) // 2 : len(own) // 2] = passage.split()
        out.append(" ".join(own) + ("\n" + line + "  \n\tshort\n" if i % 2 else ""))
    for i in range(12):
        copy = list(base)
        for _ in range(i % 5):
            copy[rng.randrange(len(copy))] = "changed" + str(i)
        out.append(" ".join(copy))
    out += [out[-1]] * 3 + ["same words here again and"] * 2 + [" ".join(prose(rng, 30_000))]
    out.append(passage + " " + passage)
    return out
