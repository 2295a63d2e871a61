"""Notices are learned from the corpus: those that no seed is like are found too."""

import random

from weftline.llm import residue

NEW = ["Diese Ansicht konnte nicht geladen werden. Kennung {n}", "Please switch on scripts in {w} to read on", "Sorry, {w} took a nap. Come back in {n} minutes", "Brak dostępu do zasobu {w}"]


def test_notices_that_are_no_seeds_are_learned_from_hints():
    rng = random.Random(3)
    nouns = [f"noun{a}{b}" for a in "abcdef" for b in "ghijkl"]
    sentence = lambda: f"The {rng.choice(nouns)} of the {rng.choice(nouns)} sees a {rng.choice(nouns)} and after that it was with the {rng.choice(nouns)} for {rng.randint(2, 99)} days."
    notice = lambda: rng.choice(NEW).format(n=rng.randint(1, 999), w=rng.choice(nouns))
    # A hint is given for half of the notices and for a twentieth of all others.
    short = [(rng.random() < 0.5, [notice()]) for _ in range(120)] + [(rng.random() < 0.05, [sentence()]) for _ in range(300)]
    learned = residue.notices_of(short)
    assert learned and not any(x.startswith("The ") for x in learned)
    pages = [[sentence() for _ in range(6)] for _ in range(150)]
    model = residue.ResidueModel.fit_twice(pages, learned)
    held = [notice() for _ in range(60)]
    hits = [residue.coverage([x], model) for x in held]
    assert sum(h >= residue.COVERAGE * n for h, n in hits) >= 57
    assert not any(h >= residue.COVERAGE * n for h, n in (residue.coverage([sentence(), sentence()], model) for _ in range(60)))


def test_nothing_is_learned_without_hints():
    assert residue.notices_of([]) == [] and residue.notices_of([(False, ["404 not found"])] * 9) == [] and residue.notices_of([(True, ["x"])] * 9) == []


def test_seeds_are_used_whole():
    # A placeholder far to the right of a long sentence, and a word late in the alphabet, are learned as well.
    prose = [" ".join(["zebra", "walks", "by"] * 20)] * 40
    filler, notices = residue.seeds(["zebra"] * 3, prose, random.Random(1))
    assert max(len(x.split()) for x in notices) > 40
