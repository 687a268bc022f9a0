import random

import pytest


@pytest.fixture
def prose():
    """Seeded text of invented words."""
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioklmnrst") for _ in range(rng.randint(2, 8))) for _ in range(600)]

    def make(n: int) -> str:
        return " ".join(rng.choice(words) for _ in range(n))

    return make
