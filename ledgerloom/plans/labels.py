"""Labels of the star tables translated to the labels the rules know.

One brand, one segment and no region or channel are left untranslated on purpose:
the rules then meet labels their tables do not hold.
"""

from __future__ import annotations

from ledgerloom.operators.rulebook import SEASONAL_FACTORS

BRANDS = 24
PRODUCT_LABELS = {f"Brand#{n}": list(SEASONAL_FACTORS)[(n - 1) % len(SEASONAL_FACTORS)] for n in range(1, BRANDS + 1)}
REGION_LABELS = {
    "AFRICA": "South",
    "AMERICA": "West",
    "ASIA": "East",
    "EUROPE": "North",
    "MIDDLE EAST": "Central",
}
SEGMENT_LABELS = {
    "AUTOMOBILE": "Enterprise",
    "BUILDING": "SMB",
    "FURNITURE": "Consumer",
    "HOUSEHOLD": "Education",
}
CHANNEL_LABELS = {
    "1-URGENT": "Direct",
    "2-HIGH": "Partner",
    "3-MEDIUM": "Online",
    "4-NOT SPECIFIED": "Retail",
    "5-LOW": "Online",
}
LABELS = {
    "product": PRODUCT_LABELS,
    "region": REGION_LABELS,
    "customer_segment": SEGMENT_LABELS,
    "sales_channel": CHANNEL_LABELS,
}
