"""The angle of a page against a loop, and its exchange."""

import math
import random
from collections import Counter

from ledgerflow.operators import ocr

ANGLES = [math.radians(-3.0 + 0.2 * k) for k in range(31)]
COLUMNS = "file_id string, page_no int, left double, top double, text string"


def loop(words):
    best = []
    for a in ANGLES:
        ys = [None if left is None or top is None else top - left * math.tan(a) for left, top in words]
        placed = [y for y in ys if y is not None]
        if not placed:
            return ANGLES[0]
        n = Counter(None if y is None else math.floor((y - min(placed)) / 4.0) for y in ys)
        bins = math.floor((max(placed) - min(placed)) / 4.0) + 1
        best.append(round(sum(c * c for c in n.values()) / bins - (len(ys) / bins) ** 2, 9))
    return ANGLES[best.index(max(best))]


def test_angle_is_that_of_a_loop_and_words_are_exchanged_once(spark):
    rnd = random.Random(4)
    pages = {("a", p): [(rnd.uniform(0, 1500), 30.0 * rnd.randrange(n) + rnd.uniform(0, 3)) for _ in range(n)] for p, n in enumerate((1, 2, 9, 60, 200))}
    for p, tilt in enumerate((-2.0, 1.0)):
        pages["b", p] = [(x, 100 + 30.0 * row + x * math.tan(math.radians(tilt))) for row in range(10) for x in (20.0, 200.0, 760.0)]
    pages["c", 1] = [(None, 5.0)]
    pages["c", 2] = [(None, 5.0), (None, 7.0), *pages["a", 2]]
    rows = [(*page, left, top, "x") for page, words in pages.items() for left, top in words] + [("a", 0, 3.0, 50.0, " "), ("d", 1, 3.0, 50.0, "")]
    words = spark.createDataFrame(rows, COLUMNS)
    found = ocr.skew_angle(words)
    assert {(r.file_id, r.page_no): r.angle for r in found.collect()} == {page: loop(w) for page, w in pages.items()}
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
