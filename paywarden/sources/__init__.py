"""Reading, standardising, writing and withdrawing pay data."""
