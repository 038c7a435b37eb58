"""Data-preparation operators over series and readings."""
