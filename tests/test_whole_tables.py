"""Operators against brute force."""

import random

from roamframe.operators import visits

SIDES = "location_id long, x0 double, y0 double, x1 double, y1 double"


def outer_boxes(boxes):
    """Ids left when repeated boxes and boxes in others are gone."""
    first = {}
    for i, *box in boxes:
        first[tuple(box)] = min(i, first.get(tuple(box), i))
    within = lambda a, b: a != b and a[0] >= b[0] and a[1] >= b[1] and a[2] <= b[2] and a[3] <= b[3]
    return sorted(i for a, i in first.items() if not any(within(a, b) for b in first))


def test_box_overlap(spark):
    rng = random.Random(3)
    boxes = []
    for i in range(400):
        x, y = rng.randrange(-15, 60) / 2, rng.randrange(-15, 60) / 2
        boxes.append((i, x, y, x + rng.randrange(0, 30) / 2, y + rng.randrange(0, 30) / 2))
    for size in (3.0, 10.0):
        got = visits.box_overlap(spark.createDataFrame(boxes, SIDES), size)
        assert sorted(r.location_id for r in got.collect()) == outer_boxes(boxes)
