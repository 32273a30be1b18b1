"""A small corpus with planted cases."""

import random


def small_corpus():
    rng = random.Random(9)
    say = {"en": ["the", "house", "of", "with", "water", "night"], "de": ["das", "haus", "und", "wasser", "nicht", "schön"], "fr": ["la", "maison", "de", "avec", "être", "nuit"]}
    make = lambda lang, n: " ".join(rng.choice(say[lang]) + rng.choice(["", "", "a", "e", "in"]) for _ in range(n))
    rows = [(i, "\n".join(make(x, 12) for _ in range(5)), x, "s", 0) for i, x in enumerate(["en", "de", "fr"] * 60)]
    passage = make("en", 60)
    rows[0] = (0, make("en", 20) + "\n" + passage, "en", "s", 0)
    rows[3] = (3, passage + "\n" + make("en", 20), "en", "s", 0)
    item = make("en", 15)
    rows.append((700, make("en", 20) + ". " + item + " " + make("en", 20), "en", "s", 0))
    base = make("en", 200).split()
    for i in range(3):  # near copies on one line each, so that no line repeats
        w = list(base)
        w[50 * i + 7] = f"changed{i}"
        rows.append((800 + i, " ".join(w), "en", "s", 0))
    rows += [(900, None, "en", "s", 0), (901, "12 34 !!", None, "s", 0)]
    return rows, [(1, item), (2, make("de", 12))]
