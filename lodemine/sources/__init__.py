"""Readers of images, detections and stage tables, and the writers that go with them."""
