"""What the nodes of a deep tree say of a text is united on the way, with the same result as at the end."""

import random

import numpy as np
from geoloom.llm import suffixes


def test_small_blocks_give_the_same_spans(monkeypatch):
    rng = random.Random(5)
    left, right = (bytes(rng.choice(b"ab") for _ in range(40)) for _ in range(2))
    # Every text shares another part of both sides with the others, so that the trees are deep.
    texts, places = [], []
    for i in range(60):
        a, b = rng.randrange(41), rng.randrange(41)
        before = bytes(rng.choice(b"cd") for _ in range(40 - a)) + left[40 - a :]
        texts.append(before + right[:b] + bytes(rng.choice(b"cd") for _ in range(40 - b)))
        places.append(40)
    groups, lengths = np.repeat([0, 1], 30), [10, 25]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.arange(0, 80 * 61, 80)
    spans = lambda: sorted(zip(*(x.tolist() for x in suffixes.repeated(data, offsets, np.array(places), groups, lengths)), strict=True))
    whole = spans()
    monkeypatch.setattr(suffixes, "ENTRIES", 8)
    assert spans() == whole

    covered = {(t, n, x) for t, n, a, b in whole for x in range(a, b)}
    around, anywhere = set(), set()  # bytes of repeated windows that touch the anchor, and of all at the same distance from it
    for t in range(60):
        for n in lengths:
            for a in range(81 - n):
                if any(texts[u][a : a + n] == texts[t][a : a + n] for u in range(60) if u != t and groups[u] == groups[t]):
                    anywhere |= {(t, n, x) for x in range(a, a + n)}
                    if a <= 40 <= a + n:
                        around |= {(t, n, x) for x in range(a, a + n)}
    assert around and around <= covered <= anywhere
