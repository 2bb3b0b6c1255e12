"""Relational operators: cleaning, chunking, graph, retrieval, evaluation."""
