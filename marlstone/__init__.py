"""Retrieval, graph and vector analytics over document collections, as Spark DataFrame operators."""
