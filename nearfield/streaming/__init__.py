"""Ordered, sealable event timelines, in batch and as streams."""
