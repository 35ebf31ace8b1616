"""Fixed values of the pricing, discount and assignment rules.

Every rule takes its table as an argument and uses these as the default.
"""

from __future__ import annotations

# Product -> seasonal factor.
SEASONAL_FACTORS = {
    "Laptop": "1.2",
    "Desktop": "1.0",
    "Monitor": "1.1",
    "Keyboard": "1.0",
    "Mouse": "1.0",
    "Headphones": "1.3",
    "Tablet": "1.4",
    "Smartphone": "1.5",
    "Printer": "0.9",
    "Webcam": "1.2",
    "Speaker": "1.1",
    "Router": "1.0",
}

# Months of raised demand -> multiplier.
SEASONS = {(11, 12): "1.5", (8, 9): "1.2"}

# Customer segment -> price multiplier.
SEGMENT_MULTIPLIERS = {"Enterprise": "2.5", "SMB": "1.5", "Consumer": "1.0", "Education": "1.2"}

# Region -> economic strength, technology adoption.
REGION_STRENGTH = {"North": "1.2", "South": "0.9", "East": "1.1", "West": "1.3", "Central": "1.0"}
REGION_ADOPTION = {"North": "1.3", "South": "0.8", "East": "1.1", "West": "1.4", "Central": "1.0"}
TECHNOLOGY_PRODUCTS = ("Laptop", "Desktop", "Smartphone", "Tablet", "Webcam")

# Channel -> discount range in per cent; other channels as Retail.
CHANNEL_DISCOUNTS = {"Partner": (5, 15), "Direct": (8, 20), "Online": (0, 10), "Retail": (0, 8)}
OTHER_CHANNEL_DISCOUNT = CHANNEL_DISCOUNTS["Retail"]

# Least quantity -> tier name and added discount range, largest first.
VOLUME_TIERS = {5: ("bulk", (3, 8)), 3: ("multi", (1, 5)), 0: ("single", (0, 0))}

# Performance tier -> multiplier, and name suffix.
TIER_MULTIPLIERS = {
    "top_performer": "1.8",
    "high_performer": "1.4",
    "average_performer": "1.0",
    "low_performer": "0.6",
}
TIER_SUFFIXES = {"top_performer": " (Top)", "high_performer": " (High)", "low_performer": " (Low)"}
GOOD_TIER_DISCOUNT = "0.8"
POOR_TIER_DISCOUNT = "1.3"

# Days of history before the reference day.
HISTORY_DAYS = 730
