import random
from collections import Counter

import pandas as pd
import pytest

from tilewright.streaming import stateful


class Entries(dict):
    """A map state that counts its calls."""

    def __init__(self):
        self.calls = Counter()

    def iterator(self):
        self.calls["iterator"] += 1
        return iter([*self.items()])

    def containsKey(self, k):
        self.calls["containsKey"] += 1
        return k in self

    def getValue(self, k):
        return self[k]

    def updateValue(self, k, v):
        self.calls["updateValue"] += 1
        self[k] = v

    def removeKey(self, k):
        self.calls["removeKey"] += 1
        del self[k]


class Sums:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, v):
        self.held = v


def cache(**limits):
    made = stateful._Cache(limits.get("max_entries"), limits.get("max_bytes"), limits.get("ttl"))
    made.entries, made.sums = Entries(), Sums()
    return made


def put(made, rows):
    return [r for b in made.handleInputRows(("c",), iter([pd.DataFrame(rows, columns=["key", "added", "bytes"])]), None) for r in b.itertuples(index=False, name=None)]


def test_entries_that_go_in_their_batch_are_never_stored():
    made = cache(max_entries=5)
    for first in (0, 60):
        put(made, [(f"k{k}", k, 1) for k in range(first, first + 60)])
        assert sorted(made.entries) == sorted((f"k{k}",) for k in range(first + 55, first + 60))
    assert made.entries.calls["updateValue"] == 10 and sum(made.entries.calls.values()) <= 12


@pytest.mark.parametrize("limits", [{"max_entries": 30}, {"max_bytes": 300}, {"max_entries": 40, "ttl": 25}, {}])
def test_caches_read_whole_or_by_key_are_alike(monkeypatch, limits):
    rng = random.Random(3)
    turns = [[(f"k{rng.randrange(60)}", t * 5 + rng.randrange(-9, 9), rng.randrange(20)) for _ in range(rng.randrange(1, 12))] for t in range(60)]
    found = []
    for walked in (0, 1_000):
        monkeypatch.setattr(stateful, "WALKED", walked)
        made = cache(**limits)
        found.append(([sorted(put(made, rows)) for rows in turns], dict(made.entries), made.sums.held))
        assert made.sums.held[:2] == (len(made.entries), sum(own for _, own in made.entries.values()))
    assert found[0] == found[1]
