import random
import tracemalloc

import pyarrow as pa
import pytest

from molquarry.functions import batch, strings
from molquarry.functions.batch import Texts, bounded, in_arrow, joined
from molquarry.functions.dialect import Counted


def test_memory_of_a_batch_does_not_follow_its_texts():
    """Masks and positions are made for some texts at a time; each text is seen once and in order."""
    texts = ["CCO" * 700, "", "c1ccccc1"] * 10_000
    rows = pa.array(texts)
    kept = sum(map(len, texts))
    assert [t for part in joined(rows) for t in part.texts] == texts
    tracemalloc.start()
    for part in joined(rows):
        part.pattern("[A-Z]+")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert kept > 20 * batch.JOINED and peak < 100 * batch.JOINED
    assert [len(p.texts) for p in joined(pa.array(["x" * (3 * batch.JOINED), "y"]))] == [1, 1] and not list(joined(pa.array([], pa.string())))


@pytest.mark.parametrize("family", [strings.PATTERN_SHARES, strings.STRING_DOCUMENTED, strings.STRING_PATTERNS, strings.STRING_RATIOS])
def test_arrow_counts_as_the_joined_pattern(family):
    """Also with line ends, NUL, letters of other scripts and matches at both ends of a text."""
    rng = random.Random(7)
    signs = ["C", "c", "N", "n", "O", "o", "S", "P", "H", "F", "Cl", "Br", "(", ")", "[", "]", "=", "#", "+", "-", "1", "2", "%", "@", "\n", "\x00", "é", "字", "C(=O)", "[H]", "N([H])", "X4", " "]
    texts = Texts(["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(400)])
    d = Counted()
    family.outputs(d)
    patterns = [what for kind, what in d.wanted if kind == "pattern" and in_arrow(what)]
    assert len(patterns) > 10
    for p in patterns:
        assert texts.pattern(p).tolist() == texts._per_row([m.start() for m in bounded(p).finditer(texts.joined)]).tolist(), p
    assert not any(map(in_arrow, ("^C", "(^|N)C", "(?<=C)O", r"\bC", "C*", r"\d")))
