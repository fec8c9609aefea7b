import math

import numpy as np
import pytest

from test_text_models import _log_kt, _nodes
from urlloom.llm import context_tree as ct


def _brute(texts, asked, depth):
    nodes = _nodes(texts, depth)
    stop, log_w, below = {}, {}, {}
    for d in range(depth, -1, -1):
        for (level, c, path), (a, b) in nodes.items():
            if level == d:
                own = _log_kt(a, b)
                log_w = own if d == depth else math.log(0.5) + np.logaddexp(own, below[d, c, path])
                stop[d, c, path] = 1.0 if d == depth else math.exp(math.log(0.5) + own - log_w)
                if d:
                    below[d - 1, c[1:], path] = below.get((d - 1, c[1:], path), 0.0) + log_w
    scores = []
    for t in asked:
        total, data = 0.0, bytes([255]) * depth + t + bytes([255])
        for i in range(depth, len(data)):
            for b in range(8):
                path, bit, p, deeper = (1 << b) | (data[i] >> (8 - b)), (data[i] >> (7 - b)) & 1, 0.5, False
                for d in range(depth, -1, -1):
                    k = (d, data[i - d : i], path)
                    if k in nodes:
                        w = stop[k] if deeper else 1.0
                        p, deeper = w * (nodes[k][1] + 0.5) / (sum(nodes[k]) + 1) + (1 - w) * p, True
                total += math.log10(p if bit else 1 - p)
        scores.append(total)
    return scores


@pytest.mark.parametrize("slot_bits", [0, 4, 22])
def test_scores_come_from_the_whole_tree_whatever_is_broadcast(spark, slot_bits):
    texts = ["abracadabra", "abba", "", "banana bandana", "Grüße aus Köln", "the cat and the dog and the end"]
    asked = [*texts, "abrakadabra", "zzz", "ünd the bands", "中文"]
    train = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id long, text string")
    lower = lambda ts: [t.encode().lower() for t in ts]
    got = {r.doc_id: r.score for r in ct.score(docs, train, depth=3, slot_bits=slot_bits).collect()}
    for i, want in enumerate(_brute(lower(texts), lower(asked), 3)):
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_an_empty_training_table_gives_uniform_bytes(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert ct.score(docs, docs.filter("false"), depth=3).first().score == pytest.approx(4 * 8 * math.log10(0.5))
