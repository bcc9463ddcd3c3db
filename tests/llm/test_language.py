"""Long texts: counted in slices, with the same n-grams and in flat memory."""

import random
import tracemalloc

from quernel.llm import language


def test_slices_count_the_same():
    rng, letters = random.Random(4), language._letters()
    for _ in range(300):
        text = "".join(rng.choice(["a", "B", "é", "ß", "Σ", "日", "𐐀", " ", "\n", "1", "-", "  "]) for _ in range(rng.randint(0, 90)))
        assert "".join(language.slices(text, 7)) == text
        want, got = language._grams(text, letters), language.grams(text, letters, 7)
        assert all((a == b).all() for a, b in zip(want, got, strict=True))


def test_memory_does_not_grow_with_a_text():
    letters, unit = language._letters(), "Some words of a very long text, "
    peaks = []
    for n in (200_000, 1_000_000):
        text = unit * n
        tracemalloc.start()
        found, counts = language.grams(text, letters)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        own, one = language._grams(unit * 10, letters)
        assert (found == own).all() and (counts * 10 == one * n).all()
    assert peaks[1] < 1.2 * peaks[0]
