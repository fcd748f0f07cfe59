"""Made-up prose."""

WORDS = "the of and to in a is that it for on was with as der die und das nicht ein la le et les des que est pour"


def prose(n, seed):
    import random

    rng = random.Random(seed)
    common = WORDS.split()
    return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("aeiou") + rng.choice("bdklmnrst") for _ in range(rng.randint(1, 4))) for _ in range(n))
