"""What the trees over URLs learn, on rows that they have not seen."""

from __future__ import annotations

import random

from ledgerline.llm import url_filters


def _urls():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("aeioulmnrst", k=rng.randint(4, 9)))
    for i in range(1500):
        if i % 3:
            yield i, f"https://{word()}.example.net/{word()}/{word()}.html", 0.0
        else:
            yield i, f"http://{word()}{rng.randint(100, 999)}.example.net/{rng.randint(10**9, 10**10)}?a={word()}&b=1&c=2", 1.0


def test_op10_trees_judge_unseen_hosts(spark):
    rows = list(_urls())
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id bigint, url string")
    labels = spark.createDataFrame([(u, y) for _, u, y in rows], "url string, label double").dropDuplicates(["url"])
    told = url_filters.held_out(url_filters.featured(pages, [], labels))
    assert told["urls"] > 200 and told["usual"] < 0.75 and told["accuracy"] >= 0.95


def test_op10_labels_without_a_signal_block_little(spark):
    """Labels by a coin, one in four a block: the features must not give them away."""
    rows = [(i, u, float(random.Random(i).random() < 0.25)) for i, u, _ in _urls()]
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id bigint, url string")
    labels = spark.createDataFrame([(u, y) for _, u, y in rows], "url string, label double").dropDuplicates(["url"])
    told = url_filters.held_out(url_filters.featured(pages, [], labels))
    assert told["blocked"] < 0.15 and told["accuracy"] > told["usual"] - 0.1


def test_op10_suffix_rate_leaves_out_the_own_fold(spark):
    rows = [(i, f"http://h{i}.zz/", float(i % 4 == 0)) for i in range(400)]
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id bigint, url string")
    labels = spark.createDataFrame([(u, y) for _, u, y in rows], "url string, label double")
    found = url_filters.featured(pages, [], labels).select("fold", "label", "suffix_block_rate").collect()
    for fold in range(url_filters.FOLDS):
        others = [r.label for r in found if r.fold != fold]
        wanted = (sum(others) + 20 * 0.25) / (len(others) + 20)
        rates = [r.suffix_block_rate for r in found if r.fold == fold]
        assert rates and all(abs(r - wanted) < 1e-12 for r in rates)


def test_op10_verdicts(spark):
    """Labels for every other URL: the rest is judged right. By a coin: nothing is blocked."""
    rows = list(_urls())
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id bigint, url string")
    told = {i: y for i, _, y in rows}
    some = spark.createDataFrame([(u, y) for i, u, y in rows if i % 2], "url string, label double")
    made = url_filters.judge(pages, [], some.dropDuplicates(["url"])).collect()
    right = [(r.verdict == "block") == (told[r.page_id] == 1) for r in made if r.page_id % 2 == 0]
    assert len(made) == len(rows) and sum(right) >= 0.95 * len(right)
    coin = [(u, float(random.Random(i).random() < 0.25)) for i, u, _ in rows if i % 2]
    none = spark.createDataFrame(coin, "url string, label double").dropDuplicates(["url"])
    made = url_filters.judge(pages, [], none).collect()
    assert sum(r.verdict == "block" for r in made) < 0.02 * len(made)
