"""Tessera: chunking, retrieval, reranking and retrieval evaluation as Spark DataFrame plans."""
