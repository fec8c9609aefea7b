import corpus_pipeline


def _shingles(text, size=5):
    words = text.lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def test_near_duplicate_stage_links_five_word_shingles_from_four_fifths_on(spark):
    base = [f"w{i}" for i in range(60)]
    swap = lambda words, *at: [f"x{i}" if i in at else w for i, w in enumerate(words)]
    texts = {
        1: base,
        2: swap(base, 0, 59),  # far above
        3: swap(base, 30),  # 51 of 61 shingles: 0.836, at four words 0.869
        11: [f"a{w}" for w in base],
        12: swap([f"a{w}" for w in base], 0, 2, 59),  # 0.86
        21: [f"b{w}" for w in base],
        22: swap([f"b{w}" for w in base], 30, 31),  # 50 of 62: 0.806, at four words 0.839
        31: [f"c{w}" for w in base],
        32: swap([f"c{w}" for w in base], 20, 40),  # below
    }
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    sets = {i: _shingles(" ".join(w)) for i, w in texts.items()}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    assert root[22] == 21 and root[32] == 32
    got = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    assert got == {i for i in root if root[i] == i}
