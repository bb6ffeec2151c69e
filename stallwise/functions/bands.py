"""Bands for lateness and freight, and the customer segment grid."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lateness labels with their last day.
ON_TIME = "On Time"
LATE_BANDS = (("Late (1-7 days)", 7), ("Late (8-14 days)", 14))
LATEST_BAND = "Late (15+ days)"

# Freight labels with their first and last amount.
FREE = "Free"
FREIGHT_BANDS = (("1-20 BRL", 1, 20), ("21-40 BRL", 21, 40), ("41-60 BRL", 41, 60), ("61-80 BRL", 61, 80))
TOP_FREIGHT_BAND = "80+ BRL"
UNKNOWN_FREIGHT = "Unknown"
FREIGHT_LABELS = (FREE, *[name for name, _, _ in FREIGHT_BANDS], TOP_FREIGHT_BAND, UNKNOWN_FREIGHT)

# Segment by recency score (row) and frequency score 1 to 5.
SEGMENT_GRID = {
    1: ("Lost", "Needs Attention", "Needs Attention", "At Risk", "At Risk"),
    2: ("Others", "Needs Attention", "Needs Attention", "At Risk", "At Risk"),
    3: ("Promising", "Promising", "Others", "Others", "Others"),
    4: ("Promising", "Promising", "Potential Loyalist", "Loyal Customer", "Loyal Customer"),
    5: ("New Customer", "New Customer", "Potential Loyalist", "Loyal Customer", "Loyal Customer"),
}
CHAMPION = "Champion"
CHAMPION_SCORES = ((5, 5, 5), (5, 5, 4), (4, 5, 5))  # recency, frequency, monetary


def lateness_band(on_time: str, delay_days: str, same_day_is_first_band: bool = False) -> Column:
    """Punctuality label of a delivery.

    A delivery later than promised but on the promised calendar day has a delay
    of 0 days. It belongs to no day band and so to the last label, unless
    ``same_day_is_first_band`` is set.
    """
    label = F.when(F.col(on_time) == 1, ON_TIME)
    first_day = 0 if same_day_is_first_band else 1
    for name, last_day in LATE_BANDS:
        label = label.when(F.col(delay_days).between(first_day, last_day), name)
        first_day = last_day + 1
    return label.otherwise(LATEST_BAND)


def freight_band(cents: str, without_gaps: bool = False) -> Column:
    """Number of an item's freight band, for :func:`freight_label`.

    The bands have whole-number edges, so an amount between two bands (20.50),
    a negative one and NULL all fall into the top band. ``without_gaps`` closes the
    gaps and sets negative and NULL amounts apart.
    """
    amount = F.col(cents)
    band = F.when(amount == 0, FREIGHT_LABELS.index(FREE))
    if without_gaps:
        band = band.when(amount.isNull() | (amount < 0), FREIGHT_LABELS.index(UNKNOWN_FREIGHT))
    for name, low, high in FREIGHT_BANDS:
        in_band = amount <= high * 100 if without_gaps else amount.between(low * 100, high * 100)
        band = band.when(in_band, FREIGHT_LABELS.index(name))
    return band.otherwise(FREIGHT_LABELS.index(TOP_FREIGHT_BAND))


def freight_label(band: str) -> Column:
    labels = F.array(*[F.lit(name) for name in FREIGHT_LABELS])
    return F.element_at(labels, F.col(band) + 1)


def customer_segment(r: str, f: str, m: str) -> Column:
    """Segment from the three 1-to-5 scores."""
    recency, frequency, monetary = F.col(r), F.col(f), F.col(m)
    champion = reduce(or_, [(recency == a) & (frequency == b) & (monetary == c) for a, b, c in CHAMPION_SCORES])
    labels = F.array(*[F.lit(name) for row in sorted(SEGMENT_GRID) for name in SEGMENT_GRID[row]])
    cell = (recency - 1) * 5 + frequency
    return F.when(champion, CHAMPION).otherwise(F.element_at(labels, cell.cast("int")))
