"""Relational operators over annotations, features, votes, graphs and embeddings."""
