"""The fast forms of the patterns against the plain ones, in matches and in time."""

import re
import time

from pyspark.sql import functions as F

from mojiframe.functions import emoji_lexicon as L
from mojiframe.functions import text as TX


def test_nested_classes_hold_the_same_code_points():
    def holds(cls: str, cp: int) -> bool:  # the nested form, read by hand
        body = cls[1:-1]
        if "&&" not in body:
            return any(lo <= cp <= hi for lo, hi in ((int(a, 16), int(b, 16)) for a, b in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", body)))
        depth, parts, start = 0, [], 0
        if not body.startswith("["):
            lo, hi = (int(x, 16) for x in re.match(r"\\x\{(\w+)\}-\\x\{(\w+)\}&&", body).groups())
            return lo <= cp <= hi and holds(body.split("&&", 1)[1], cp)
        for i, c in enumerate(body):
            depth += (c == "[") - (c == "]")
            if depth == 0:
                parts.append(body[start:i + 1])
                start = i + 1
        return any(holds(p, cp) for p in parts)

    for ranges in (L.emoji_ranges(), L.high_starter_ranges()):
        tree = L.class_tree(ranges)
        edges = {cp + d for r in ranges for cp in r for d in (-1, 0, 1)}
        assert all(holds(tree, cp) == any(lo <= cp <= hi for lo, hi in ranges) for cp in edges)


def test_fast_patterns_match_as_the_plain_ones(spark):
    """Code points alone, between words and doubled; and the fast forms are fast: the text is gone through
    in less than half the time that the plain patterns take."""
    h = F.lpad(F.hex("id"), 8, "0")
    cps = spark.range(1, 0xE0200, numPartitions=4).where("id < 12000 or id between 63000 and 66000 or id between 126000 and 131000 or id > 917000").select(F.decode(F.unhex(h), "UTF-32").alias("c"))
    t = cps.select(F.explode(F.array("c", F.concat(F.lit("a1"), "c", F.lit(" é#"), "c", "c", F.lit("\ufe0f\u200d"), "c"))).alias("t"))
    found = [F.regexp_extract_all("t", F.lit(f"({p})"), 1) for p in (TX.EMOJI, TX.SEQ)] + [F.regexp_extract_all("t", F.lit(TX.PIECES), 1)]
    fast = [F.regexp_extract_all("t", F.lit(f"({p})"), 1) for p in (TX.EMOJI_FAST, TX.SEQ_FAST)] + [TX.pieces("t")]
    one = [F.col("t").rlike(f"^{TX.EMOJI}$"), TX.is_emoji("t")]
    assert t.where(F.struct(*found, one[0]) != F.struct(*fast, one[1])).count() == 0

    text = spark.range(8).select(F.repeat(F.lit("ordinary words, 12 and é "), 20_000).alias("t")).persist()
    text.count()
    def seconds(patterns):
        took = []
        for _ in range(2):
            begin = time.time()
            text.select(*[F.size(F.regexp_extract_all("t", F.lit(p), 1)) for p in patterns]).write.format("noop").mode("overwrite").save()
            took.append(time.time() - begin)
        return min(took)
    assert 2 * seconds([f"({TX.EMOJI_FAST})", f"({TX.SEQ_FAST})", TX.PIECES_FAST]) < seconds([f"({TX.EMOJI})", f"({TX.SEQ})", TX.PIECES])
    text.unpersist()
