"""The weights are fitted on all labelled lines of the sample."""

import numpy as np

from weftline.llm import body


def test_a_long_line_counts_wherever_it_stands():
    words = {w: i + 2 for i, w in enumerate("lantern archive visit rain ending slow record every nobody counts while keeps waits and the".split())}
    line = " ".join(words) + "."
    for place in range(4):
        text = "\n".join(["short"] * place + [line] + ["short"] * 3)
        model = body.fit([("a.example", None, text)], body.Corpus(words, {}, {}, set(), set()))
        slots, rows = body._features([body.tokens(line)], [True], words)
        assert body._scores(slots, rows, 1, model.furniture)[0] < 0, place
        assert np.isfinite(model.furniture).all()
