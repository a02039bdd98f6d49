"""Texts for tests."""

import random

WORDS = [f"{a}{b}" for a in ("re", "to", "an", "li", "mo", "su", "ka") for b in ("ne", "st", "ring", "dal", "or", "vik")]


def prose(seed, n):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        word = rng.choice(WORDS) + rng.choice(["", "", rng.choice(WORDS)])
        out.append(word.capitalize() if k % 12 == 0 else word + ("." if k % 12 == 11 else ""))
    return " ".join(out) + "."


def edited(text, seed, edits):
    rng, words = random.Random(seed), text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS) + "x"
    return " ".join(words)
