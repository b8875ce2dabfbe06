"""Fixed tables of the archive's colour system, salience tiers and statistics."""

from __future__ import annotations

# Colour codes in display order, with names, ranking weights and export tags.
COLOUR_CODES = ("u", "p", "b", "g", "g2", "y", "o")
COLOUR_NAMES = {"u": "Purple", "p": "Pink", "b": "Blue", "g": "Green", "g2": "Green", "y": "Yellow", "o": "Orange"}
RANK_WEIGHTS = {"u": 5.0, "p": 4.0, "b": 3.0, "g": 2.0, "g2": 2.0, "y": 1.0, "o": 0.5}
TAGS = {"u": "PUR", "p": "PNK", "b": "BLU", "g": "GRN", "g2": "GRN", "y": "YEL", "o": "ORN"}
OLD_TAGS = {"u": "PUR", "p": "PNK", "b": "BLU", "g": "GRN", "g2": "DGR", "y": "YLW", "o": "ORA"}
# Stored salience swaps purple and pink; the live archive view does not.
SALIENCE_WEIGHTS = {"p": 5.0, "u": 4.0, "b": 3.0, "g": 2.0, "g2": 2.0, "y": 1.0, "o": 0.5}
LIVE_SALIENCE_WEIGHTS = {"u": 5.0, "p": 4.0, "b": 3.0, "g": 2.0, "y": 1.0, "o": 0.5}
BOLD_BONUS = 0.5
NODE_BONUS = 0.5
TOP_WEIGHT = 5.5

# Highlight colours of rich text, by RGB and by hex.
RGB_CODES = {
    (255, 153, 204): "p", (204, 255, 255): "b", (204, 255, 204): "g", (255, 255, 255): None, (255, 255, 153): "y", (255, 204, 153): "o", (204, 153, 255): "u",
    (153, 204, 0): "g2", (255, 255, 0): "y", (255, 0, 0): "o", (0, 255, 0): "g", (255, 0, 255): "u", (255, 153, 0): "o", (255, 204, 0): "y",
}
HEX_CODES = {
    "FF99CC": "p", "CCFFFF": "b", "CCFFCC": "g", "FFFF99": "y", "FFCC99": "o", "CC99FF": "u", "99CC00": "g2", "FFFF00": "y", "FF0000": "o",
    "00FF00": "g", "FF00FF": "u", "FF9900": "o", "FFCC00": "y", "339966": "g2", "808000": "y", "99CCFF": "b", "008000": "g2", "FF6600": "o",
}
NEAR_COLOUR = 10000  # squared RGB distance below which the nearest colour counts

# Export tiers, highest first; nb is bold without colour, n is any text without colour.
TIERS = (
    (("u", "p"), "purple+pink"), (("b",), "blue"), (("g", "g2"), "green"), (("y",), "yellow"), (("o",), "orange"), (("nb",), "bold (uncoloured)"), (("n",), "uncoloured"),
)
# Budgets in characters offered for exports (0: none), and the older exporter's presets.
EXPORT_BUDGETS = (24_000, 110_000, 470_000, 3_700_000, 0)
PRESETS = {
    "compact": {"codes": ("u", "p"), "budget": 0, "green_percent": 100},
    "standard": {"codes": ("u", "p", "b"), "budget": 180_000, "green_percent": 100},
    "rich": {"codes": ("u", "p", "b", "g"), "budget": 400_000, "green_percent": 50},
    "full": {"codes": ("u", "p", "b", "g"), "budget": 600_000, "green_percent": 100, "split": 180_000},
    "max": {"codes": ("u", "p", "b", "g"), "budget": 0, "green_percent": 100},
}

# Two-sided 5 % points of Student's t by degrees of freedom; 1.96 beyond the last.
T_POINTS = {1: 12.71, 2: 4.30, 3: 3.18, 4: 2.78, 5: 2.57, 6: 2.45, 7: 2.36, 8: 2.31, 9: 2.26, 10: 2.23, 12: 2.18, 15: 2.13, 20: 2.09, 25: 2.06, 30: 2.04, 40: 2.02, 60: 2.00}
T_BEYOND = 1.96

# BM25 as full-text engines default to.
BM25_K1, BM25_B, BM25_IDF_FLOOR = 1.2, 0.75, 1e-6

# Half-open length buckets of the chunk histogram.
LENGTH_BUCKETS = (0, 20, 50, 100, 200, 400, 800, 1600)
