"""Made-up prose for the tests."""


def sentence(rng, n, words=None):
    words = words or [a + b for a in ("ba", "ke", "lo", "mi", "nu", "so", "ta") for b in ("ran", "tel", "vis", "dom", "pek", "")]
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(n))
