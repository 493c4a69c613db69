"""Documents with the awkward rows every operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, key string, n long, text2 string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


def edited(rng: random.Random, text: str, edits: int) -> str:
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS) + "x"
    return " ".join(words)


def documents(seed: int = 0, n: int = 120) -> list[tuple]:
    """Originals, exact copies, near copies, shared lines, and null, empty, tiny, blank and very long texts."""
    rng = random.Random(seed)
    shared = [sentence(rng, 12) for _ in range(4)]
    texts: list[str | None] = [None, "", " \n\t ", "a", "a", "A b", "é😀 ß\n\né😀 ß", "\n\n\n", sentence(rng, 60_000)]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.45 or len(texts) < 12:
            body = [sentence(rng, rng.randint(1, 90)) for _ in range(rng.randint(1, 6))]
            texts.append("\n".join([*body, rng.choice(shared).upper() + "  "] if rng.random() < 0.5 else body))
        elif kind < 0.65:
            texts.append(rng.choice(texts[9:]))
        else:
            texts.append(edited(rng, rng.choice(texts[9:]), rng.randint(1, 6)))
    texts += [texts[-1]] * 30
    rows = [(i, t, "en", rng.choice(["hot", "hot", "s1", "s2", None]), len(t or ""), 5, "k", 1, "other") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows
