"""End-to-end plans and plug-in points."""
