"""Word-blocked lookups against brute force, and the stages of the full run."""

import random

import pytest
from pyspark.sql import functions as F

from shelf.operators import matching
from shelf.plans.match_cascade import match_cascade
from tests.test_matching import CAND, REF, make, ratio


def jaccard(a, b):
    a, b = set(a.split()), set(b.split())
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.55, 0.8])
def test_rare_words_lose_no_pair(spark, threshold):
    rng = random.Random(23)
    words = ["hot"] + [f"w{i}" for i in range(12)]

    def name():
        return " ".join(["hot"] * (rng.random() < 0.9) + rng.sample(words[1:], rng.randint(1, 6)))

    refs = [(i, name(), "", "", "g", 1.0, 1.0, 1.0, "") for i in range(60)]
    cands = [(f"p{i:03d}", name(), "", "", "1 g", 1.0, 1.0, "", i) for i in range(80)]
    got = {r.item_code: r.product_id for r in matching.best_name_match(
        spark.createDataFrame(refs, REF), spark.createDataFrame(cands, CAND), ["ord"], similarity="token_jaccard",
        min_score=threshold).collect()}
    for r in refs:
        score, _, best = max((jaccard(r[1], c[1]), -c[8], c[0]) for c in cands)
        assert got[r[0]] == (best if score >= threshold else None)


def test_top_candidates(spark):
    refs, cands, ref, cand = make(spark, 25, 50, seed=9)
    rows = matching.top_candidates(ref, cand, 3, ["ord"]).collect()
    for r in refs:
        query = f"{r[2]} {r[1]}".strip()
        scored = []
        for c in cands:
            full = f"{c[2]} {c[1]}".strip()
            if set(query.split()) & set(full.split()):
                s = ratio(query, full)
                scored.append((-(min(1.0, s + 0.1) if r[2] and r[2] in full else s), c[8], c[0]))
        want = [p for _, _, p in sorted(scored)[:3]]
        assert [x.product_id for x in sorted((x for x in rows if x.item_code == r[0]), key=lambda x: x.rank)] == want


@pytest.mark.parametrize("similarity,metric", [("ratcliff", ratio), ("token_jaccard", jaccard)])
def test_id_then_fuzzy(spark, similarity, metric):
    refs, cands, ref, cand = make(spark, 30, 40, seed=13)
    ref = ref.withColumn("ref_product_id", F.when(F.col("item_code") < 5, F.concat(F.lit("p"), F.col("item_code"))))
    got = {r.item_code: (r.method, r.product_id) for r in matching.id_then_fuzzy(ref, cand, ["ord"], similarity=similarity).collect()}
    for r in refs:
        if r[0] < 5:
            assert got[r[0]] == ("id_exact", f"p{r[0]}")
            continue
        query = f"{r[2]} {r[1]}".strip()
        rows = []
        for c in cands:
            full = f"{c[2]} {c[1]} {c[4]}".strip()
            heads = {w for w in full.split()[:3] if len(w) >= 3}
            near = bool({w for w in query.split() if len(w) >= 3} & heads)
            if set(query.split()) & set(full.split()):
                s = metric(query, full)
                rows.append((near, min(1.0, s + 0.1) if r[2] and r[2] in full else s, -c[8], c[0]))
        rows = [x for x in rows if x[0]] or rows
        best = max((x[1:] for x in rows), default=(0, 0, None))
        assert got[r[0]] == (("fuzzy", best[2]) if best[0] >= 0.5 else (None, None)), r


def test_stages_of_the_full_run_are_disjoint_but_for_weak_rows(spark):
    refs, cands, ref, cand = make(spark, 60, 80, seed=17)
    fetched = ref.where("item_code < 20").select("item_code", F.lit("x").alias("product_id"), F.lit("n").alias("own_name"),
                                                 F.lit(80.0).alias("own_price"),
                                                 F.when(F.col("item_code") < 10, "ok").otherwise("error").alias("status"))
    searched = cand.withColumn("item_code", F.col("ord"))
    rows = match_cascade(ref, fetched, cand, ["ord"], searched=searched, similarity="levenshtein").collect()
    stages = {}
    for r in rows:
        stages.setdefault(r.item_code, []).append((r.stage, r.score))
    assert {i for i, s in stages.items() if s[0][0] == 1} == set(range(10))
    for item, claimed in stages.items():
        claimed.sort()
        if len(claimed) > 1:
            assert [s for s, _ in claimed] == [2, 3] and claimed[0][1] < 0.6
    assert len({s for c in stages.values() for s, _ in c}) >= 3


def test_each_city_and_platform_is_matched_for_itself(spark):
    by = ["platform", "pincode"]
    ref, cand = make(spark, 30, 40, seed=3)[2:]
    places = [("x", 1), ("x", 2), ("y", 1)]

    def everywhere(df, some):
        found = None
        for platform, pincode in some:
            part = df.withColumn("platform", F.lit(platform)).withColumn("pincode", F.lit(pincode))
            found = part if found is None else found.unionByName(part)
        return found

    refs, listings = everywhere(ref, places), everywhere(cand, places)
    # item 1 was fetched on one platform in one city only
    fetched = everywhere(ref.where("item_code = 1"), places[:1]).select(
        *by, "item_code", F.lit("f").alias("product_id"), F.lit("n").alias("own_name"), F.lit(80.0).alias("own_price"), F.lit("ok").alias("status"))
    pictures = refs.select(*by, "item_code", F.lit("none").alias("product_id"), F.col("item_code").cast("long").alias("hash"))
    # every product is listed twice in each place
    listed = listings.unionByName(listings.withColumn("ord", F.col("ord") + 1000))
    seen = listed.select(*by, "product_id", "ord", F.col("ord").cast("long").alias("hash"))
    rows = match_cascade(refs, fetched, listed, ["ord"], hashes=(pictures, seen), similarity="levenshtein", by=by).collect()
    keys = [(r.platform, r.pincode, r.item_code, r.stage) for r in rows]
    assert len(keys) == len(set(keys)) and any(r.stage == 5 for r in rows)
    assert [(r.platform, r.pincode) for r in rows if r.stage == 1] == [("x", 1)]
    alone = match_cascade(ref, fetched.drop(*by).limit(0), cand.unionByName(cand.withColumn("ord", F.col("ord") + 1000)), ["ord"],
                          hashes=(pictures.where("platform = 'y'").drop(*by), seen.where("platform = 'y'").drop(*by)), similarity="levenshtein").collect()
    got = {(r.item_code, r.stage, r.product_id) for r in rows if r.platform == "y"}
    assert got == {(r.item_code, r.stage, r.product_id) for r in alone}
