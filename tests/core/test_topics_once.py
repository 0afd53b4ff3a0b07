import math
from collections import Counter

import numpy as np

from cartoflux.operators import keywords, semantic
from cartoflux.plans.text_queries import QUERIES


def test_texts_are_embedded_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"first second word{i % 7} other{i % 3}") for i in range(60)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    whole, seen = semantic.hashing_embedder, f"{tmp_path}/seen"

    def counting(texts):
        with open(seen, "a") as out:
            out.write("x" * len(texts))
        return whole(texts)

    monkeypatch.setitem(semantic.EMBEDDERS, "hashing", counting)
    QUERIES["semantic_topics"](spark, str(tmp_path)).collect()
    with open(seen) as made:
        assert len(made.read()) <= 120  # once for the width, which looks at the first rows, and once for all


def test_pairs_of_rare_words_are_no_terms(spark):
    """The vocabulary is that of all pairs counted, ties and groups with few words included."""
    rng = np.random.default_rng(5)
    docs = [(g, i, [f"w{min(int(w), 40)}" for w in rng.zipf(1.4, 30)]) for g, n in (("a", 40), ("b", 25), ("c", 1)) for i in range(n)]
    titles = spark.createDataFrame([(g, hash((g, i)) % 10**9, " ".join(w)) for g, i, w in docs], "lang string, id long, title string")
    for most in (3, 12, 1000):
        got = {(r["lang"], r["term"]): r["score"] for r in keywords.term_scores(titles, "lang", most, stop=[]).collect()}
        want = {}
        for g in "abc":
            own = [Counter(w + [f"{x} {y}" for x, y in zip(w, w[1:], strict=False)]) for h, _, w in docs if h == g]
            total = sum(own, Counter())
            kept = sorted(total, key=lambda t: (-total[t], t))[:most]
            idf = {t: math.log((1 + len(own)) / (1 + sum(t in c for c in own))) + 1 for t in kept}
            for c in own:
                norm = math.sqrt(sum((c[t] * idf[t]) ** 2 for t in kept))
                for t in kept:
                    if c[t]:
                        want[g, t] = want.get((g, t), 0) + c[t] * idf[t] / norm
        assert got.keys() == want.keys()
        assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_words_are_dropped(spark, tmp_path):
    """Of tables as large as the titles none is left when the scores are there."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    name, free = "spark.checkpoint.dir", spark.conf.isModifiable("spark.checkpoint.dir")
    was = spark.conf.get(name, None)
    spark.conf.set(name, f"file://{tmp_path}") if free else None
    rng = np.random.default_rng(8)
    titles = spark.createDataFrame([(i, " ".join(f"w{v}" for v in rng.integers(0, 400, 200))) for i in range(500)], "id long, title string")
    assert keywords.term_scores(titles, most=50, stop=[]).count() == 50
    if free:
        spark.conf.set(name, was) if was else spark.conf.unset(name)
    assert sum(f.stat().st_size for f in tmp_path.rglob("part-*")) < 20_000
