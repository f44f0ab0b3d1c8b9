"""Whole plans: the weekly dataset, forecast evaluation, and the query catalogue."""
