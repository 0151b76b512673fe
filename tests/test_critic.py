"""The hybrid critic: replies applied, damaged replies, responses without claims."""

import json

from pyspark.sql import functions as F

from vellum.operators import critic

CLAIMS = "id int, claim_index int, claim string, max_similarity double, evidence string"


def review(spark, texts, claims, reply, **kw):
    responses = spark.createDataFrame(texts, "id int, text string")
    out = critic.review_hybrid(responses, spark.createDataFrame(claims, CLAIMS), "id", provider=lambda p: F.when(p.isNotNull(), F.lit(reply)), **kw)
    return {r.id: r for r in out.collect()}


def test_reply_is_applied(spark):
    issues = [{"severity": s, "claim": c} for s, c in (("low", "a"), ("high", "b"), ("odd", "c"), (None, "d"), ("medium", "e"), ("high", "f"))]
    corrections = [{"original": "cost $5", "corrected": "cost $1\\0"}, {"original": "", "corrected": "x"}, {"original": "gone", "corrected": "y"}, {"original": "cost", "corrected": "price"}]
    reply = "Here:\n```json\n" + json.dumps({"supported_count": 1, "issues": issues, "corrections": corrections}) + "\n```"
    got = review(spark, [(1, "It cost $5. It cost $5.")], [(1, 0, "x", 0.9, "e"), (1, 1, "y", 0.4, None), (1, 2, "z", None, "e"), (1, 3, "v", 0.75, "e")], reply, max_issues=4)[1]
    assert [x.claim for x in got.issues] == ["b", "f", "e", "a"]
    assert got.corrected_response == "It price $1\\0. It cost $5." and len(got.corrections) == 4
    assert (got.total_claims, got.passed_claims, got.factual_accuracy, got.confidence_score, got.is_supported) == (4, 2, 0.75, 0.45, False)
    assert (got.source_alignment, got.consistency) == (0.5125, 0.8)


def test_only_flagged_claims_are_asked(spark):
    texts = [(1, "good"), (2, "bad"), (3, None), (4, "")]
    got = review(spark, texts, [(1, 0, "good", 0.8, "e"), (2, 0, "bad", 0.1, "e")], "no JSON {")
    assert [(r.factual_accuracy, r.is_supported, r.corrected_response) for _, r in sorted(got.items())] == [(1.0, True, "good"), (0.0, False, "bad"), (0.0, False, None), (0.0, False, "")]
    assert all(r.issues == [] and r.corrections == [] for r in got.values())
    assert (got[1].consistency, got[2].consistency, got[3].total_claims) == (1.0, 0.9, 0)


def test_prompt_lists_claims_in_order(spark):
    seen = spark.createDataFrame([([(0, "a", 0.1, "e"), (1, "b", 0.2, "")],)], "f array<struct<claim_index:int,claim:string,similarity:double,evidence:string>>")
    text = seen.select(critic.flagged_prompt(F.col("f")).alias("p")).first().p
    assert text.endswith("[1] CLAIM (similarity 0.1): a\nEVIDENCE: e\n\n[2] CLAIM (similarity 0.2): b\nEVIDENCE: ")
