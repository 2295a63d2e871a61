"""Placeholders of a page are sought in lines that may hold one."""

import numpy as np

from weftline.llm import residue


HOLES = ["{{ a.b }} and %NAME% or <WORD> [your text here] __NAME__ #{q}", "${x}", "<%= a.b %>", "100 %", "[insert word]"]


def test_holes_are_sought_where_they_may_be(monkeypatch):
    asked, hole = [], residue._HOLE

    class Asked:
        findall = staticmethod(lambda x: asked.append(x) or hole.findall(x))

    monkeypatch.setattr(residue, "_HOLE", Asked)
    page = ["plain words"] * 30 + HOLES
    few = np.full(50, -3.0)
    assert residue.natural(page, few) == (12 * sum(len(hole.findall(x)) for x in page) < len(few))
    assert page[0] not in asked and HOLES[0] in asked
