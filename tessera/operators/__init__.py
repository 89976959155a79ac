"""Operators over DataFrames: recall, fusion, reranking, evidence, chunks, conversations, memory and sheets."""
