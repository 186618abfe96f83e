"""Ranges inside a row equal the joined ones and take no shuffle; masks search only texts with their signs."""

import random

from pyspark.sql import functions as F

from proselake.operators import intervals as iv
from proselake.plans import spans
from proselake.sources import masking


def test_gaps_equal_the_difference(spark):
    rnd, outer, holes = random.Random(4), [], []
    for doc in range(40):
        cuts = sorted(rnd.sample(range(200), 6))
        outer += [(doc, a, z) for a, z in zip(cuts[::2], cuts[1::2], strict=True)]
        holes += [(doc, a, a + rnd.randint(1, 30)) for a in (rnd.randint(0, 199) for _ in range(rnd.randint(0, 9)))]
    kind = "doc_id long, start int, end int"
    want = {tuple(r) for r in iv.difference(spark.createDataFrame(outer, kind), spark.createDataFrame(holes, kind)).select("doc_id", "outer_start", "start", "end").collect()}
    mine = {(d, *g) for d in range(40) for g in iv.gaps([x[1:] for x in outer if x[0] == d], [x[1:] for x in holes if x[0] == d])}
    assert mine and mine == want


def test_readable_ranges_shuffle_nothing(spark):
    plan = spans.readable_ranges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "hashpartitioning" not in plan


def test_masks_search_only_texts_with_their_signs(spark):
    marked = ["---\na: b\n---\nx", "```\na\n```\nb", "~~~\nq", "    code\n\tcode", "a [b](c) ![d](e)", '"q" [^1] z', "`x`", "> quote", "<b>x</b>", "plain", None]
    d = spark.createDataFrame([(t,) for t in marked], "t string")
    for pattern in masking.NEEDS:
        new, old = (F.coalesce(f, F.lit("")) for f in (masking.replaced(F.col("t"), pattern, masking.blanked), masking.rebuilt(F.col("t"), pattern, masking.blanked, lambda g: g)))
        assert d.where(new != old).count() == 0
        assert d.where(F.col("t").rlike(pattern)).count() > 0
