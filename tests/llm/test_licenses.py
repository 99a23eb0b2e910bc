"""The licence index: what its filters leave, against counting all words."""

import random
from math import ceil

from tidewater.llm import licenses


def test_filters_leave_all_that_holds_enough_and_prune_by_place():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    templates = [(f"t{k}", " ".join(rng.sample(vocabulary, rng.randrange(12, 30)))) for k in range(20)]
    frequency = {w.encode(): rng.randrange(5) for w in vocabulary}
    index = licenses.Index.build(templates, frequency, 0.8)
    left = met = 0
    for _ in range(2000):
        base = rng.choice(templates)[1].split() if rng.random() < 0.5 else []
        held = {w.encode() for w in rng.sample(base, int(len(base) * rng.uniform(0.6, 1))) + rng.sample(vocabulary, rng.randrange(0, 20)) + ["other"] * 3}
        got = index.candidates(held)
        for k, t in enumerate(index.templates):
            if sum(w in held for w in t.own) >= ceil(0.8 * len(t.own) - 1e-9):
                assert k in got
            met += any(w in held for w in t.own[: len(t.own) - t.need + 1]) and len(held) >= t.need
        left += len(got)
    assert left < 0.9 * met  # prefix and length alone would leave all of met


def test_a_place_with_too_little_behind_it_gives_a_template_up():
    template = " ".join(f"w{i:02d}" for i in range(20))
    index = licenses.Index.build([("t", template)], {f"w{i:02d}".encode(): i for i in range(20)} | {b"z": 0}, 0.8)
    words = [f"w{i:02d}".encode() for i in range(20)]
    assert index.candidates(set(words)) == {0} == index.candidates(set(words[4:])) == index.candidates(set(words[:16]))
    # Its first words are there, and enough words in all; but of the template fewer than 16 stand from any of them on.
    assert index.candidates({*words[:5], *[f"x{i}".encode() for i in range(30)]}) == set()
    assert index.candidates({*words[:1], *words[6:]}) == set()
