"""Projections to the delivery and export formats."""
