"""Statistics of line templates cover all records, not the sample that weights are fitted on."""

from weftline.llm import body, templates

WORDS = "the lantern keeps a slow record of every visit while the archive waits for rain and nobody counts".split()


def long_line(i):
    return " ".join(WORDS[i % 7 :] + WORDS[: i % 7]) + f" and so page {chr(97 + i % 26)}{chr(97 + i // 26)} ended well."


def test_furniture_of_a_small_site_is_counted_over_all_records(spark):
    rows = []
    for i in range(300):
        site = "small.example" if i < 8 else f"site{i % 20}.example"
        menu = "Guides › Tarifs › Contact" if i < 8 else f"Menu of {site.split('.')[0]} here"
        once = "Only here" if i == 0 else "Other"
        rows.append((i, site, f"Title {i}", body.pack("\n".join([menu, f"Title {i}", *(long_line(i + 40 * k) for k in range(5)), once]))))
    pages = spark.createDataFrame(rows, "row bigint, site string, title string, t string")
    one = [(rows[0][1], rows[0][2], "\n".join(["Guides › Tarifs › Contact", "Title 0", *(long_line(40 * k) for k in range(5)), "Only here"]))]
    corpus, repeated = templates.count(pages, len(rows), one)
    k = body.keyed(one[0][0], one[0][1], body.pack(one[0][2]), corpus.words)
    assert corpus.within.get(k.within[0]) == 1, "eight records of 300, one of them in the sample"
    assert k.within[-1] not in corpus.within and k.cross[-1] not in corpus.cross
    assert {r.row for r in repeated.collect() if k.within[0] in r["keys"]} == set(range(8))
    assert {"lantern", "archive"} <= set(corpus.words)
    assert body.fit(one, corpus).furniture.any()
