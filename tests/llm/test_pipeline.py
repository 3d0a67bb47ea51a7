"""The pipeline and its stages: names that clash, repeated rows, nulls, empty tables, brute force."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import jaccard_join, packing, pii, quality_rules
from ledgerline.llm.decontamination import keep_clean
from tests.llm.test_queries import leads, nearest, shingle_set, words

ITEM = "Quite another passage tells of rivers, hills and a very old stone bridge near some town."
PROSE = "A plain sentence of a dozen words or so stands here with number {} and {}."


def frame_of(spark, rows):
    """Rows of doc_id and text, with columns named like helpers of the stages."""
    extra = ["source", "gone", "row", "clean", "spans", "hit_id", "id", "name", "again_id", "__gone", "__bad", "__key", "n", "node"]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    return frame.select("doc_id", "text", *[F.lit(f"x{c}").alias(c) for c in extra])


def test_stages_keep_the_columns(spark):
    rows = [(1, PROSE.format(1, 2)), (1, PROSE.format(1, 2)), (None, ITEM), (None, ITEM)]
    rows += [(None, None), (2, "mail a.b@example.org now " + PROSE.format(5, 6)), (3, None)]
    frame = frame_of(spark, rows)
    items = spark.createDataFrame([(9, ITEM)], "item_id bigint, text string")
    stages = {
        "good": quality_rules.keep_good(frame),
        "one": jaccard_join.keep_one(frame, jaccard_join.Rule(5, 80)),
        "clean": keep_clean(frame, items),
        "private": pii.redact(frame),
    }
    for made in stages.values():
        assert made.columns == frame.columns
        assert all(r[f"{c}"] == f"x{c}" for r in made.collect() for c in frame.columns[2:])
    texts = {k: Counter((r.doc_id, r.text) for r in made.collect()) for k, made in stages.items()}
    assert texts["good"] == Counter((d, t) for d, t in rows if t)
    # one row of a repeated document, one of each text without an id
    assert texts["one"][1, PROSE.format(1, 2)] == texts["one"][None, ITEM] == 1
    assert sum(texts["one"].values()) == 5
    # the text that holds the item goes, not all that have no id
    assert (None, ITEM) not in texts["clean"] and texts["clean"][None, None] == 1
    assert texts["clean"][1, PROSE.format(1, 2)] == 2
    assert texts["private"][2, "mail <email> now " + PROSE.format(5, 6)] == 1


def test_pipeline_of_empty_tables(spark, empty_folder):
    assert corpus_pipeline.run(spark, empty_folder).collect() == []


def test_pipeline_by_brute_force(spark, folder):
    """The first three stages by plain Python, the last two by their round trip."""
    rows = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    kept = {(r.doc_id, r.kept) for r in quality_rules.judge(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    texts = {r["doc_id"]: r["text"] for r in rows if (r["doc_id"], True) in kept}
    sets = {d: shingle_set(words(t), 5) for d, t in texts.items()}
    holders = defaultdict(list)
    for d, own in sets.items():
        for x in own:
            holders[x].append(d)
    shared = Counter((a, b) for h in holders.values() for i, a in enumerate(h) for b in h[i + 1 :])
    near = [p for p, n in shared.items() if 100 * n >= 80 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    lead = leads(sets, near)
    items = [words(r["text"]) for r in pq.read_table(f"{folder}/benchmark.parquet").to_pylist()]
    held = set()
    for d in (d for d in texts if lead[d] == d):
        own = words(texts[d])
        if any(set(w) & set(own) and nearest(w, own) <= len(w) // 5 for w in items if len(w) >= 6):
            held.add(d)
    wanted = {d for d in texts if lead[d] == d}
    pieces = defaultdict(dict)
    for r in corpus_pipeline.run(spark, folder).collect():
        pieces[r.doc_id][r.start] = r
    # the search for items finds nine tenths of them at least, and nothing else
    assert wanted - held <= set(pieces) <= wanted and len(wanted - set(pieces)) >= 0.9 * len(held)
    path = public_tokenizers.path(packing.RANKS)
    for d, own in pieces.items():
        assert sum(r.length for r in own.values()) == next(iter(own.values())).doc_tokens
        if not re.search(r"[@+=:#]|[0-9][ .-]?[0-9]", texts[d]):
            assert next(iter(own.values())).doc_tokens == len(packing.ids_of(texts[d], path)) + 1


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, " " * 999_999 + "word", "\t \n" * 700_000 + "é", " " * 5_000_000])
def test_long_blank_runs_have_the_ids_of_tokenizers(text):
    own = packing.tokenizer(public_tokenizers.path(packing.TOKENIZER))
    ids = packing.ids_of(text, public_tokenizers.path(packing.RANKS))
    assert np.array_equal(ids, np.array(own.encode(text, add_special_tokens=False).ids, "<u4"))
