"""Numbered queries against their SQL twins, and the pipeline against its stages' brute-force forms."""

import os
import sys
from collections import Counter, defaultdict

import brute
import pytest
from compare import compare, duck

from verimet.llm.catalog import ORACLES, QUERIES

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_twin(spark, name):
    rows, same, _, note = compare(spark, duck(FOLDER), FOLDER, QUERIES[name], ORACLES[name])
    assert rows and same, note


def test_pipeline(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from verimet.llm.common import stored, table

    docs, kept = table(spark, FOLDER, "documents"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), f"test-{name}")
        kept.append([tuple(r) for r in docs.collect()])
        assert docs.columns == columns or name == "tokens"
    good, single, clean, mix, tokens = kept
    labels = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    assert sum(labels.get(r[0], 1) == 0 for r in good) <= 2
    near = brute.near([r[:2] for r in good])
    assert Counter(single) == Counter(r for r in good if near[r[0]][2])
    items = [tuple(r) for r in table(spark, FOLDER, "benchmark").select("item_id", "text").collect()]
    dirty = {r[0] for r in brute.contamination([r[:2] for r in single], items) if r[5]}
    assert Counter(clean) == Counter(r for r in single if r[0] not in dirty)
    copies = Counter(mix)
    assert set(copies) <= set(clean) and max(copies.values()) <= 3
    size = lambda r: len(brute.words(r[1], brute.SOLID))
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in clean:
        sizes[r[3]] += size(r)
        largest[r[3]] = max(largest[r[3]], size(r))
    for r, n in copies.items():
        taken[r[3]] += n * size(r)
    for source, target in brute.targets(dict(sizes)).items():
        assert abs(taken[source] - target) <= max(0.02 * target, largest[source])
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    assert sorted(tokens) == brute.token_rows(sorted(r[:2] for r in mix), tokenizer)
    assert corpus_pipeline.run(spark, FOLDER).count() == len(tokens)
