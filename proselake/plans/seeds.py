"""Trigger phrases that both engines append to the prose tables, which have none of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselake.sources.readers import spread, table

SEEDS = [
    " However, we are sorry to say it — truly.",
    "\n\nMoreover, it never ends. However, nobody knows. Furthermore, it is late. Moreover, nothing helps. Everyone always waits. Moreover, if it never stops, is it not guaranteed?",
    " He said — and she said — that it — always — was.",
    "",
    " 😀 Sorry. Sorry!",
    " A rich tapestry, nestled in the heart of it. Let's dive into the world of state of the art work. It underscores the importance; in conclusion, a game-changer.",
    " To be fully transparent, I’ll be honest. Here's why the real bottleneck is here. Think about it. The key is this: the load-bearing wall stands. A load bearing idea falls.",
    " It is the fastest, far better and 3.5 times faster. “Curly” and \"straight\" \"quotes\" “mix”. oaicite turn0search12 utm_source=chatgpt.com",
    "\n\nWhile it rains, we wait. Although late, we go. However, we stay. Obviously it is so. Certainly. They think clearly that it is. Clearly, the end is near. Undoubtedly so.",
    " The truth is plain. This approach is good. That method can help. These patterns are odd: most people say so, every team knows, people think it is widely used. Despite these challenges, the future is bright.",
    " You can run or walk; both will give rest. Not a plan. Not a promise. It isn't a dream. A good day is a good thing. It works properly. (maybe not) I think so. Perhaps it does, to be honest.",
    " The NATO plan. Then NATO again. The XQZ unit (Xylo Quartz Zone) and XQZ.\nIt ends here.\n- one\n- two\n\nIt goes on\n- three\n\n1. four\n2. five",
    "\n\nThe plannedQueue keeps `readTable` and `write_log(x)`, unless fooBar (see B12) fails; only then, except for legacy rows, never above max_len, it stops: the filter is capped, and the rest (no more) goes below, because it was so before, after all.",
    "\n\nStrong teams build careful systems through patient review. Rivers flow. Careful systems are built by strong patient teams through review. No river ever flows. Patient reviews build strong careful system teams because so that more tall green houses grow.",
    "\n\nStrong patient teams build careful systems through review.\n\nThrough patient review strong teams build careful systems. “Maybe” not.\n\n- one strong patient team builds\n- careful systems through review\n- and rests\n\n- two strong patient teams build\n- careful systems through review\n- and rest again",
    " We delve into a realm, harness the wind, buy a harness and foster a pivotal, holistic view of it. Words like delve are AI words. A tapestry. Studies show it, experts say. “Perhaps” so.",
    " Split here.  He said (quietly.) Then “left.” After\n \nthat it stopped…  Yes?! No.",
]


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = F.element_at(F.array(*(F.lit(s) for s in SEEDS)), (F.col("doc_id") % len(SEEDS) + 1).cast("int"))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", F.concat("text", pick).alias("text"))
