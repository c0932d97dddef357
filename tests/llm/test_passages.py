"""Line de-duplication finds passages that the test itself has planted; nothing here asks where chunks end."""

import random

import pytest

from mojiframe.llm import linededup

PAIRS = 60


def fresh(rng, n):
    return [f"w{rng.randrange(1 << 30)}" for _ in range(n)]


def sentences(rng, words):
    out, at = [], 0
    while at < len(words):
        own = words[at:at + rng.randint(8, 22)]
        at += len(own)
        out += [*own[:-1], own[-1] + "."]
    return out


def left_of(spark, make):
    """For each pair of texts with a passage in common: the other words of both, what both became, and the passage."""
    planted, rows = [], []
    for k in range(PAIRS):
        passage, one, two = make(random.Random(k))
        planted.append(passage.split())
        rows += [(2 * k, one), (2 * k + 1, two)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found, gone = [], []
    for k, passage in enumerate(planted):
        assert got[2 * k] == rows[2 * k][1]                              # the first place stays
        own = set(passage)
        after, before = got[2 * k + 1].split(), rows[2 * k + 1][1].split()
        assert [x for x in after if x not in own] == [x for x in before if x not in own]
        gone.append(1 - sum(x in own for x in after) / len(passage))
        found.append(gone[-1] > 0)
    return sum(found) / PAIRS, sum(gone) / PAIRS


@pytest.mark.parametrize("size,found,gone", [(60, 0.9, 0.5), (200, 1, 0.8), (2000, 1, 0.95)])
@pytest.mark.parametrize("cut", [sentences, lambda rng, words: words], ids=["sentences", "words"])
def test_passages_inside_a_longer_paragraph(spark, cut, size, found, gone):
    def make(rng):
        passage = cut(rng, fresh(rng, size))
        around = [cut(rng, fresh(rng, rng.randint(20, 80))) for _ in range(4)]
        return " ".join(passage), *(" ".join([*a, *passage, *b]) for a, b in (around[:2], around[2:]))

    got = left_of(spark, make)
    assert got[0] >= found and got[1] >= gone


def test_an_edited_word_hides_little_of_a_paragraph(spark):
    def make(rng):
        passage = fresh(rng, 300)
        edited = [*passage[:150], *fresh(rng, 1), *passage[151:]]
        return " ".join(passage), " ".join(passage), " ".join(edited)

    got = left_of(spark, make)
    assert got[0] == 1 and got[1] >= 0.85


@pytest.mark.parametrize("lines,words", [(3, 20), (4, 15), (5, 11), (8, 8), (8, 10)])
def test_passages_of_short_lines(spark, lines, words):
    def rows(rng, n):
        return ["\n".join(" ".join(fresh(rng, words)) for _ in range(n))]

    def make(rng):
        passage = rows(rng, lines)
        around = [rows(rng, rng.randint(1, 6)) for _ in range(4)]
        return passage[0], *("\n".join([*a, *passage, *b]) for a, b in (around[:2], around[2:]))

    got = left_of(spark, make)
    assert got[0] >= 0.95 and got[1] >= 0.6
