"""Spark-first engine for document graphs: sources, segmentation, graph building, retrieval."""
