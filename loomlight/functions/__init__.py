"""loomlight package."""
