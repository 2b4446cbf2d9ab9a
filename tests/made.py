"""Invented values, built so that their check digits and shapes are valid."""

from __future__ import annotations

import random
import string

SYLLABLES = ("bo", "ker", "lum", "nia", "pos", "rud", "sev", "tal", "ves", "wen", "yor", "zil")
FILLER = ("lantern", "quiet", "river", "seven", "marble", "between", "window", "copper", "slowly", "garden", "northern", "walks")


def luhn_digit(body: str) -> str:
    """The digit that completes a card number."""
    total = sum(sum(divmod(int(d) * (2 if i % 2 == 0 else 1), 10)) for i, d in enumerate(reversed(body)))
    return str(-total % 10)


class Maker:
    """Values of each kind from a seed."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def word(self, n: int = 2) -> str:
        return "".join(self.rng.choice(SYLLABLES) for _ in range(n))

    def digits(self, n: int) -> str:
        return "".join(self.rng.choice(string.digits) for _ in range(n))

    def letters(self, n: int) -> str:
        return "".join(self.rng.choice(string.ascii_uppercase) for _ in range(n))

    def value(self, kind: str) -> str:
        if kind == "MOBILE":
            d = self.rng.choice("6789") + self.digits(9)
            return self.rng.choice((d, f"{d[:4]} {d[4:7]} {d[7:]}", f"+91-{d}"))
        if kind == "EMAIL":
            return f"{self.word()}.{self.word(1)}@{self.word()}.{self.rng.choice(('example', 'test'))}"
        if kind == "PAN":
            return self.letters(5) + self.digits(4) + self.letters(1)
        if kind == "IFSC":
            return self.letters(4) + "0" + self.digits(6)
        if kind == "CARD":
            body = "5" + self.digits(14)
            d = body + luhn_digit(body)
            return self.rng.choice((d, f"{d[:8]}-{d[8:]}"))  # groups of four would look like other numbers
        if kind == "DOB":
            return f"{self.rng.randint(1, 28)}/{self.rng.randint(1, 12)}/{self.rng.randint(1930, 2015)}"
        raise KeyError(kind)

    def filler(self, low: int = 1, high: int = 4) -> str:
        return " ".join(self.rng.choice(FILLER) for _ in range(self.rng.randint(low, high)))


def identity(kind: str, value: str) -> str:
    """What makes two spellings one value: the last ten digits of a phone number are not enough, all digits are."""
    if kind in ("MOBILE", "CARD"):
        return "".join(c for c in value if c.isdigit())
    return value.lower()
