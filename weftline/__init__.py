"""Weftline: Spark jobs for catalog, graph and corpus work."""
