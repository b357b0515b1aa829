"""lodemap: analytics on large 3-D point maps, expressed as DataFrame transformations."""
