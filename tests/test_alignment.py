"""Soft alignment of words: assignments against every permutation, and what generic words no longer do."""

import itertools
import random

from lynceus.operators import alignment
from lynceus.operators import blocking as B
from lynceus.operators import scoring as SC


def test_assignment_against_every_permutation():
    rng = random.Random(2)
    for _ in range(300):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        gains = [[rng.choice((0, 0, rng.randrange(100))) for _ in range(m)] for _ in range(n)]
        wide = gains if n <= m else [list(x) for x in zip(*gains)]
        want = max(sum(row[j] for row, j in zip(wide, order)) for order in itertools.permutations(range(len(wide[0])), len(wide)))
        assert alignment._best(gains) == want


def test_generic_words_alone_do_not_match(spark):
    listed = ["Africa Trading Company", "Asia Trading Company", "Gulf Trading Company", "Nordic Trading Group", "Vostok Holdings Ltd", "Delta Services Ltd", "", None]
    rows = spark.createDataFrame(list(enumerate(listed)), "id long, name string")
    classes = B.keyed(B.name_classes(rows, "id", "name"))
    asked = [("africa trading co", "asia trading co"), ("afrika trading co", "africa trading co"), ("vostok hldings ltd", "vostok holdings ltd"), ("vostok ltd", "vostok holdings ltd"), ("x", "")]
    pairs = spark.createDataFrame([(a, b, k) for a, b in asked for k in ("ORGANISATION", "INDIVIDUAL")], "l string, r string, entity_type string")
    found = {(r.l, r.r, r.entity_type[0]): r for r in alignment.scored(SC.features(pairs), classes).collect()}
    value = lambda a, b, k="O": found[a, b, k].alignment
    assert value(*asked[0]) < 0.15 and found[*asked[0], "O"].band == "NO_MATCH"
    assert value(*asked[0], "I") == 0.5 and value(*asked[1]) > 0.5
    assert value(*asked[3]) > 0.75  # a generic word that is missing costs little, a mistyped one is a word of its own
    assert value(*asked[2]) > 0.4
    assert value(*asked[4]) == 0 and len(found) == 10
